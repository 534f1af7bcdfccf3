"""Comment records may arrive endlessly; here they are a streaming DataFrame.

Filtering and cleaning posts keeps no state, so the batch operators run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkprint import schema
from inkprint.functions.text import strip_trailing
from inkprint.operators.vocab import corpus_lines


def read_comment_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.COMMENT).json(path)


def prepare_posts(comments: DataFrame) -> DataFrame:
    """Kept posts with cleaned text and stripped community name."""
    return corpus_lines(comments).withColumn("community", strip_trailing(F.col("community")))
