"""Verification counts over all pairs without rounding any score.

Every metric of the curve needs other-author pairs only relative to the same-author ones. So the distinct same-author
scores are computed first and sorted into settled range buckets; then each cell of the pair grid counts its other-author
scores between neighbouring same-author scores. Memory and output follow the distinct same-author scores, not the pairs.

A score must not depend on the block in which its pair is met. The exact score of a pair is therefore summed coordinate
by coordinate. A cell estimates its scores by one matrix product with a bound on the rounding error, and computes
exact ones only for pairs closer to a same-author score than that bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from inkprint.operators import pairs
from inkprint.operators.prefix import with_range_bucket
from inkprint.session import settle

SAME_BLOCK_ROWS = 2048  # at most 4 x 10^6 same-author pairs in a cell
MAX_LABEL_BUCKETS = 1 << 18
BLOCK_BYTES = 64 << 20  # vectors of one block; every cell gets all same-author scores, so there are few cells
CHUNK_KEYS = 1 << 16
WAVE_CHUNKS = 16  # a cell holds the keys of one wave, about 8 MB
PAIR_VALUES = 1 << 22  # coordinates gathered at a time for exact scores

COUNTS = "score double, pos bigint, neg bigint"


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed from the first coordinate to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def exact_closeness(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Closeness of row i of `q` and row i of `t`, the same bits wherever the two meet. Larger is closer. It orders
    pairs as the scores of `pairs` do: the cosine and the clipped dot product stand for their distance and angle."""
    if metric in ("euclidean", "manhattan"):
        total = np.zeros(len(q))
        for x, y in zip(q.T, t.T):
            total -= (x - y) * (x - y) if metric == "euclidean" else np.abs(x - y)
        return total + 0.0
    if metric == "chebyshev":
        return 0.0 - np.abs(q - t).max(axis=1, initial=0.0)
    dots = _dots(q, t)
    if metric == "angular":
        return np.clip(dots, -1.0, 1.0) + 0.0
    if metric == "linear":
        return dots + 0.0
    sizes = np.sqrt(_dots(q, q)) * np.sqrt(_dots(t, t))
    return np.divide(dots, sizes, out=np.zeros(len(dots)), where=sizes > 0) + 0.0


def estimated_closeness(q: np.ndarray, t: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Closeness of all rows of `q` with all rows of `t`, and how far an exact value may be from its estimate."""
    if metric in ("manhattan", "chebyshev"):
        total = np.zeros((len(q), len(t)))
        for x, y in zip(q.T, t.T):
            gap = np.abs(x[:, None] - y[None, :])
            if metric == "manhattan":
                total -= gap
            else:
                np.minimum(total, -gap, out=total)
        return total, 0.0
    # Sums of d products are off by at most d roundings of the sum of sizes, in either order of summation.
    unit = (q.shape[1] + 8) * 2.0 ** -49
    q_size, t_size = np.sqrt((q * q).sum(axis=1)), np.sqrt((t * t).sum(axis=1))
    if metric == "cosine":
        q, t = (np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0) for x, n in ((q, q_size), (t, t_size)))
        return q @ t.T, unit
    dots = q @ t.T
    largest = q_size.max(initial=0.0), t_size.max(initial=0.0)
    if metric == "euclidean":
        return 2.0 * dots - (q_size * q_size)[:, None] - (t_size * t_size)[None, :], unit * (largest[0] + largest[1]) ** 2
    return (np.clip(dots, -1.0, 1.0) if metric == "angular" else dots), unit * largest[0] * largest[1]


def _exact_pairs(q: np.ndarray, t: np.ndarray, rows: np.ndarray, columns: np.ndarray, metric: str) -> np.ndarray:
    step = max(1, PAIR_VALUES // max(1, q.shape[1]))
    parts = [exact_closeness(q[rows[i:i + step]], t[columns[i:i + step]], metric) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _same(q: pa.Table, t: pa.Table) -> np.ndarray:
    return q.column("label").to_numpy()[:, None] == t.column("label").to_numpy()[None, :]


def same_author_scores(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
                       block_rows: int = SAME_BLOCK_ROWS) -> DataFrame:
    """(score, pos): the distinct scores of same-author pairs and how many pairs have each. Rows meet in buckets of
    labels; a bucket with a hot label is cut into blocks by row id. Rows without a label are nobody's."""
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    sides = [s.where(F.col("label").isNotNull()) for s in (queries, targets)]
    buckets = max(tasks, min(MAX_LABEL_BUCKETS, math.ceil((queries.count() + targets.count()) / block_rows)))
    sides = [s.withColumn("_b", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")) for s in sides]
    blocks = [s.groupBy("_b").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n))
              for s, n in zip(sides, ("_n_i", "_n_j"))]
    # One row per bucket of labels, of which there are at most MAX_LABEL_BUCKETS.
    shape = F.broadcast(settle(blocks[0].join(blocks[1], "_b")))
    left, right = (s.join(shape, "_b") for s in sides)
    left = left.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_n_i")).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.col("_n_j") - 1)))
    right = right.withColumn("_j", F.pmod(F.xxhash64("id"), F.col("_n_j")).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_n_i") - 1)))

    def cell(q: pa.Table, t: pa.Table) -> pa.Table:
        scores = []
        if q.num_rows and t.num_rows:
            a, b = pairs._matrix(q, "vec"), pairs._matrix(t, "vec")
            for i in range(0, q.num_rows, pairs.TILE_ROWS):
                rows, columns = np.nonzero(_same(q.slice(i, pairs.TILE_ROWS), t))
                scores.append(_exact_pairs(a[i:i + pairs.TILE_ROWS], b, rows, columns, metric))
        values, counts = np.unique(np.concatenate(scores) if scores else np.zeros(0), return_counts=True)
        return pa.table({"score": values, "pos": counts.astype(np.int64)})

    keys = ["_b", "_i", "_j"]
    partitions = max(tasks, min(buckets, pairs.MAX_PARTITIONS))
    left = left.select(*keys, "label", "vec").toDF(*keys, "label", "vec").repartition(partitions, *keys)
    right = right.select(*keys, "label", "vec").toDF(*keys, "label", "vec").repartition(partitions, *keys)
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "score double, pos bigint")
    return cells.groupBy("score").agg(F.sum("pos").alias("pos"))


class _Between:
    """Counts scores between and at sorted bounds. `floor`, a bound of the wave before, only cuts off what lies at or
    below it; scores above the last bound count in the last wave."""

    def __init__(self, bounds: np.ndarray, floor: float | None, last: bool, metric: str) -> None:
        self.bounds = bounds if floor is None else np.r_[floor, bounds]
        self.skip, self.last, self.metric = int(floor is not None), last, metric
        self.under = np.zeros(len(self.bounds) + 1, np.int64)
        self.at = np.zeros(len(self.bounds), np.int64)

    def add(self, q: np.ndarray, t: np.ndarray, counted: np.ndarray) -> None:
        """Take the pairs marked in `counted`, all rows of `q` by all rows of `t`."""
        scores, slack = estimated_closeness(q, t, self.metric)
        ordered = np.sort(scores[counted])
        first = np.searchsorted(ordered, self.bounds - slack, "left")
        after = np.searchsorted(ordered, self.bounds + slack, "right")
        # From what is near one bound to what is near the next: certainly between the two.
        self.under += np.maximum(np.r_[first, len(ordered)] - np.r_[0, after], 0)
        near = after > first
        if near.any():
            close = np.unique(np.concatenate([ordered[i:j] for i, j in zip(first[near], after[near])]))
            rows, columns = np.nonzero(counted & np.isin(scores, close))
            exact = _exact_pairs(q, t, rows, columns, self.metric)
            low, high = np.searchsorted(self.bounds, exact, "left"), np.searchsorted(self.bounds, exact, "right")
            tied = high > low
            self.at += np.bincount(low[tied], minlength=len(self.at))
            self.under += np.bincount(low[~tied], minlength=len(self.under))

    def result(self) -> pa.Table:
        bounds, at, under = self.bounds[self.skip:], self.at[self.skip:], self.under[self.skip:-1]
        score, neg = np.r_[bounds, np.nextafter(bounds, -np.inf)], np.r_[at, under]
        if self.last:
            score, neg = np.r_[score, np.nextafter(bounds[-1], np.inf)], np.r_[neg, self.under[-1]]
        used = neg > 0
        return pa.table({"score": score[used], "pos": np.zeros(used.sum(), np.int64), "neg": neg[used]})


def interval_counts(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
                    block_rows: int | None = None, chunk_keys: int = CHUNK_KEYS,
                    wave_chunks: int = WAVE_CHUNKS) -> DataFrame:
    """(score, pos, neg) over all pairs, exact. A row has the pairs with a score that some same-author pair has, or the
    other-author pairs strictly between two such scores: their row carries the next double below the upper one (above
    the highest, the next double above it), which lies between the two whenever any double does. Along such a row the
    curve is a straight line, so area, line crossings and least cost are those of the full curve.

    The scores are closenesses of `exact_closeness`. With very many distinct same-author scores, cells are visited once
    per wave of about 10^6 of them. Empty when no pair has the same author.
    """
    if metric not in pairs.SIMILARITIES + pairs.DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; choose one of {pairs.SIMILARITIES + pairs.DISTANCES}")
    if "vec" not in queries.columns:
        raise ValueError("exact counts need dense vectors; sparse ones are compared on a grid of `decimals`")
    queries, targets = (settle(s.select("id", "label", "vec")) for s in (queries, targets))
    known = settle(same_author_scores(queries, targets, metric))
    chunks = max(1, math.ceil(known.count() / chunk_keys))
    waves = math.ceil(chunks / wave_chunks)

    placed = with_range_bucket(known.select("score"), ["score"], chunks).withColumn(
        "_w", F.floor(F.col("_bucket") / wave_chunks).cast("int"))
    # One row per wave from here to the broadcast.
    tops = placed.groupBy("_w").agg(F.max("score").alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy("_w")
    ends = tops.select("_w", F.lag("top").over(order).alias("floor"), F.lead("top").over(order).isNull().alias("last"))
    packs = placed.groupBy("_w", "_bucket").agg(F.collect_list("score").alias("bounds")).join(F.broadcast(ends), "_w")

    n_left, n_right, tasks = pairs.grid(queries, targets, block_rows, BLOCK_BYTES)
    every_i, every_j = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_left, n_right))
    every_w = F.explode(F.sequence(F.lit(0), F.lit(waves - 1)))
    bounds = packs.withColumn("_i", every_i).withColumn("_j", every_j)
    left = queries.withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")).withColumn(
        "_j", every_j).withColumn("_w", every_w).unionByName(bounds.drop("_bucket"), allowMissingColumns=True)
    right = targets.withColumn("_j", F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")).withColumn(
        "_i", every_i).withColumn("_w", every_w)
    keys = ["_i", "_j", "_w"]
    partitions = min(n_left * n_right * waves, max(4 * tasks, pairs.MAX_PARTITIONS))
    left = left.toDF(*left.columns).repartition(partitions, *keys)
    right = right.toDF(*right.columns).repartition(partitions, *keys)

    def cell(q: pa.Table, t: pa.Table) -> pa.Table:
        is_bound = q.column("bounds").is_valid()
        held, q = q.filter(is_bound), q.filter(pc.invert(is_bound))
        if not (held.num_rows and q.num_rows and t.num_rows):
            return pa.table({"score": pa.array([], pa.float64()), "pos": pa.array([], pa.int64()),
                             "neg": pa.array([], pa.int64())})
        bounds = np.sort(held.column("bounds").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        counts = _Between(bounds, held.column("floor")[0].as_py(), held.column("last")[0].as_py(), metric)
        a, b, step = pairs._matrix(q, "vec"), pairs._matrix(t, "vec"), pairs.TILE_ROWS
        for i in range(0, len(a), step):
            for j in range(0, len(b), step):
                counts.add(a[i:i + step], b[j:j + step], ~_same(q.slice(i, step), t.slice(j, step)))
        return counts.result()

    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, COUNTS)
    every = cells.unionByName(known.withColumn("neg", F.lit(0).cast("bigint")))
    return every.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
