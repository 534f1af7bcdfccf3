"""Rank of the true author for every query, and the ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkprint.functions.vectors import metric_distance
from inkprint.operators import pairs
from inkprint.operators.joins import join_dimension
from inkprint.operators.prefix import running_sums
from inkprint.session import settle

RECALL_AT = (1, 2, 4, 8, 16, 32, 64)
RANKS_PER_BUCKET = 65_536
MAX_BROADCAST_TARGETS = 10_000  # rows with a vector each


def mean_embedding(vectors: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector per key. Partial means are merged on the map side, so a hot key costs one row per task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dense = vectors.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    means = dense.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(*keys, vector_to_array("_m").alias("vec"))


def only_target(targets: DataFrame) -> DataFrame:
    """One row per label; a label with two or more targets is an error."""
    counted = targets.groupBy("label").agg(
        F.count("*").alias("_n"), F.first("id").alias("t_id"), F.first("vec").alias("t_vec"))
    checked = F.when(F.col("_n") == 1, F.col("t_id")).otherwise(
        F.raise_error(F.concat(F.lit("more than one target for author "), F.col("label").cast("string"))))
    return counted.select("label", checked.alias("t_id"), "t_vec")


def true_distances(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
                   decimals: int = pairs.DISTANCE_DECIMALS) -> DataFrame:
    """Queries with the id and distance of their one true target; a query without a target is an error."""
    joined = join_dimension(queries, only_target(targets), "label", "id", "left", MAX_BROADCAST_TARGETS)
    found = F.when(F.col("t_id").isNotNull(), F.col("t_id")).otherwise(
        F.raise_error(F.concat(F.lit("no target for author "), F.col("label").cast("string"))))
    distance = F.round(metric_distance(metric, F.col("vec"), F.col("t_vec")), decimals)
    return joined.select("id", "label", "vec", found.alias("true_t"), distance.alias("true_d"))


def true_rank(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
              decimals: int = pairs.DISTANCE_DECIMALS, block_rows: int | None = None) -> DataFrame:
    """1 + number of targets closer than the true one, ties by target id. Nothing is sorted and no pair leaves
    its cell: each cell returns one count per query."""
    known = settle(true_distances(queries, targets, metric, decimals))

    def reduce(q, t, d):
        true_d, true_t = q.column("true_d").to_numpy()[:, None], q.column("true_t").to_numpy()[:, None]
        t_ids = t.column("id").to_numpy()[None, :]
        closer = (t_ids != true_t) & ((d < true_d) | ((d == true_d) & (t_ids < true_t)))
        return {"q": q.column("id").to_numpy(), "label": q.column("label").to_numpy().astype(np.int64),
                "closer": closer.sum(axis=1).astype(np.int64)}

    whole = pa.int64()
    made = pairs.per_query(reduce, {"closer": np.add}, q=whole, label=whole, closer=whole)
    cells = pairs.pair_cells(known, targets, made, "q bigint, label bigint, closer bigint",
                             metric, decimals, block_rows)
    return cells.groupBy("q", "label").agg((F.sum("closer") + 1).alias("rank"))


def rank_from_scores(scores: DataFrame) -> DataFrame:
    """Ranks from a given (q, t, distance, is_match) table with exactly one match per query: count the closer ones.

    A query with a very long list is spread over several tasks by the lookup join, and the counts are combined before
    they are shuffled."""
    truth = scores.where(F.col("is_match") == 1).select(
        "q", F.col("distance").alias("true_d"), F.col("t").alias("true_t"))
    closer = (F.col("distance") < F.col("true_d")) | (
        (F.col("distance") == F.col("true_d")) & (F.col("t") < F.col("true_t")))
    return join_dimension(scores, truth, "q", "t").groupBy("q").agg((F.count_if(closer) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, n_targets: int | None = None) -> DataFrame:
    """One row of ranking metrics. Ranks are first counted; the median comes from running counts in ranges of
    `RANKS_PER_BUCKET` ranks, so that no task holds all distinct ranks."""
    counts = settle(ranks.groupBy("rank").agg(F.count("*").alias("n")))
    placed = counts.withColumn("_bucket", F.floor(F.col("rank") / RANKS_PER_BUCKET))
    running = running_sums(placed, [F.col("rank")], {"upto": F.col("n")}, totals=True)
    total = F.sum("n")
    middle = (F.col("upto_total") - 1) / 2

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("rank")))

    row = running.agg(
        (F.sum(F.col("n") / F.col("rank")) / total).alias("mrr"),
        (F.sum(F.col("n") * F.col("rank")) / total).alias("mean_rank"),
        F.min("rank").cast("bigint").alias("min_rank"),
        F.max("rank").cast("bigint").alias("max_rank"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("median_rank"),
        *[(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / total).alias(f"recall_at_{k}")
          for k in RECALL_AT],
        total.cast("bigint").alias("num_queries"),
    )
    return row if n_targets is None else row.withColumn("num_targets", F.lit(n_targets).cast("bigint"))


def rank_eval(queries: DataFrame, targets: DataFrame, metric: str = "cosine") -> DataFrame:
    """Queries against targets, end to end."""
    targets = settle(targets)
    return rank_metrics(true_rank(queries, targets, metric), targets.count())
