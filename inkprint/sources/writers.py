"""Writers. All of them write in parallel, one file set per call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from inkprint.operators.records import FeatureConfig, select_features
from inkprint.session import shuffles_dropped

SHARD_ROWS = 5000


def write_histories(histories: DataFrame | Iterable[DataFrame], path: str) -> None:
    """One JSON row per history, compressed; an existing output is kept. Several parts are written one after the other,
    and the shuffle files of one are gone before the next begins."""
    for n, part in enumerate([histories] if isinstance(histories, DataFrame) else histories):
        # Lists of numbers repeat little: codes by digit make files as small as a search for repeats, much faster.
        writer = part.write.option("compression", "gzip").option("zlib.compress.strategy", "HUFFMAN_ONLY")
        try:
            with shuffles_dropped(part.sparkSession):
                writer.mode("append" if n else "errorifexists").json(path)
        except AnalysisException as error:
            if n or error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return


def write_records(records: DataFrame, path: str, config: FeatureConfig, shard_rows: int = SHARD_ROWS) -> None:
    """Configured features only, at most `shard_rows` rows per file; an existing output is an error."""
    select_features(records, config).write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").mode(
        "errorifexists").parquet(path)


def write_corpus(lines: DataFrame, path: str, column: str = "body") -> None:
    lines.select(F.col(column).alias("value")).write.mode("ignore").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("ignore").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("ignore").option("compression", "gzip").json(path)


def write_dimension(dimension: DataFrame, path: str) -> None:
    """An existing dimension is kept, so ids stay stable across runs."""
    dimension.write.mode("ignore").parquet(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("id", "label", "vec").write.mode("errorifexists").parquet(path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """One row of metrics to (name, value) rows."""
    return metrics.select(*[F.col(c).cast("double").alias(c) for c in metrics.columns]).unpivot(
        [], metrics.columns, "name", "value")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """`name value` lines."""
    lines = metric_lines(metrics).select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_tfidf_model(model: DataFrame, path: str) -> None:
    """The fitted model is a table; an existing one is kept and reused."""
    model.write.mode("ignore").parquet(path)
