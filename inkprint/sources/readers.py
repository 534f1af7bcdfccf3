"""Readers. Schemas are explicit; file order is never relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkprint import schema
from inkprint.functions.text import WHITESPACE_CLASS

_TOKEN = f"[^{WHITESPACE_CLASS}]+"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.POST).parquet(path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, compressed or not; broken lines become nulls and are dropped with records lacking a body."""
    return spark.read.schema(schema.COMMENT).json(path, mode="PERMISSIVE").where(F.col("body").isNotNull())


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; records without the text field are skipped."""
    return spark.read.schema(schema.ARTICLE).json(path).where(F.col("cleaned_content").isNotNull())


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(first_id, pos, post_id) from lines of ids in history order; the first id stands for the history. A line that
    goes on with a long history names that id and its own first position: `@first:pos`."""
    mark = F.regexp_extract("value", r"^@\d+:\d+", 0)
    ids = F.regexp_extract_all(F.regexp_replace("value", r"^@\d+:\d+", ""), F.lit(_TOKEN), F.lit(0))
    lines = spark.read.text(path).select(mark.alias("mark"), ids.alias("ids")).where(F.size("ids") > 0)
    on = F.col("mark") != ""
    first = F.when(on, F.regexp_extract("mark", r"^@(\d+)", 1)).otherwise(F.element_at("ids", 1)).cast("bigint")
    base = F.when(on, F.regexp_extract("mark", r":(\d+)$", 1)).otherwise(F.lit("0")).cast("bigint")
    return lines.select(first.alias("first_id"), base.alias("base"), F.posexplode("ids").alias("pos", "id")).select(
        "first_id", (F.col("base") + F.col("pos")).alias("pos"), F.col("id").cast("bigint").alias("post_id"))


def read_heldout_ids(spark: SparkSession, path: str) -> DataFrame:
    ids = F.explode(F.regexp_extract_all("value", F.lit(_TOKEN), F.lit(0)))
    return spark.read.text(path).select(ids.alias("id")).select(F.col("id").cast("bigint").alias("post_id")).distinct()


def read_sample_spec(spark: SparkSession, path: str) -> DataFrame:
    """One row per author. Two lines for one author are an error, because no line is the last one in Spark."""
    spec = spark.read.schema(schema.SAMPLE_SPEC).json(path)
    fields = F.struct("num_actions_total", "start_index", "episode_length")
    single = F.when(F.col("n") == 1, F.col("s")).otherwise(
        F.raise_error(F.concat(F.lit("two sample lines for author "), F.col("author"))))
    grouped = spec.groupBy("author").agg(F.count("*").alias("n"), F.max(fields).alias("s"))
    return grouped.select("author", single.alias("s")).select("author", "s.*")


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.HISTORY).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_episode_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.EPISODE_INDEX).parquet(path)


def read_query_target(spark: SparkSession, queries: str, targets: str) -> tuple[DataFrame, DataFrame]:
    """Two separate sets of embeddings with one schema."""
    reader = spark.read.schema(schema.EMBEDDING)
    return reader.parquet(queries), reader.parquet(targets)
