"""Hard-example reports inside batches of embeddings.

A batch is a fixed number of vectors (512 in the published runs), so it is a bounded group and one task holds its
vectors. Its anchors are scored in strips against the whole batch, so no matrix grows with the square of the batch, and
only one row per anchor comes out; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.functions.vectors import euclidean

STRIP_SCORES = 1 << 21


def _batch(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and unit vectors in order of the ids; the zero vector stays zero."""
    table = table.sort_by("id")
    vectors = table.column("vec").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)
    sizes = np.linalg.norm(flat, axis=1, keepdims=True)
    unit = np.divide(flat, sizes, out=np.zeros_like(flat), where=sizes > 0)
    return table.column("id").to_numpy(), table.column("label").to_numpy(), unit


def _strips(labels: np.ndarray, unit: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For a strip of anchors at a time: its place, dot products with the whole batch, same label, and not itself."""
    height = max(1, STRIP_SCORES // len(labels))
    for start in range(0, len(labels), height):
        rows = np.arange(start, min(start + height, len(labels)))
        others = rows[:, None] != np.arange(len(labels))[None, :]
        yield slice(start, rows[-1] + 1), unit[rows] @ unit.T, labels[rows, None] == labels[None, :], others


def _report(batches: DataFrame, columns: str, strip: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """One row per anchor with what `strip(scores, same, others, place, unit)` finds, batch by batch."""

    def batch(key, table):
        ids, labels, unit = _batch(table)
        parts = [strip(scores, same, others, place, unit) for place, scores, same, others in _strips(labels, unit)]
        found = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
        return pa.table({"batch_id": np.full(len(ids), key[0].as_py(), np.int64), "anchor": ids, **found})

    return batches.groupBy("batch_id").applyInArrow(batch, f"batch_id bigint, anchor bigint, {columns}")


def anchor_report(batches: DataFrame, margin: float) -> DataFrame:
    """Each anchor against the rest of its batch: positives and negatives, and the sum of their scores. A score is the
    cosine, with `margin` added for negatives."""

    def strip(scores, same, others, place, unit):
        pos, neg = same & others, ~same
        return {"n_pos": pos.sum(1), "n_neg": neg.sum(1), "pos_sum": np.where(pos, scores, 0.0).sum(1),
                "neg_sum": np.where(neg, scores + margin, 0.0).sum(1)}

    return _report(batches, "n_pos bigint, n_neg bigint, pos_sum double, neg_sum double", strip)


def _sum_of_least(values: np.ndarray, wanted: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row the sum of the `counts` least wanted values."""
    ordered = np.sort(np.where(wanted, values, np.inf), axis=1)
    return np.where(np.arange(values.shape[1])[None, :] < counts[:, None], ordered, 0.0).sum(1)


def ranked_list_report(batches: DataFrame, margin: float, k: int) -> DataFrame:
    """Per anchor: the k-th best score, how many negatives intrude (score at least that) and how many positives are
    missed (score below it), and both cases of the ranked-list score.

    Fewer than k positives (case 1): the lowest intruders, as many as positives are missed, against all missed.
    Otherwise (case 2): all intruders against the highest missed positives, as many as there are intruders.
    """

    def strip(scores, same, others, place, unit):
        size = scores.shape[1]
        if size - 1 < k:
            raise ValueError(f"a batch has fewer than {k} other vectors")
        scores = np.where(same, scores, scores + margin)
        kth = np.partition(np.where(others, scores, -np.inf), size - k, axis=1)[:, size - k]
        intruding, missed = ~same & (scores >= kth[:, None]), same & others & (scores < kth[:, None])
        n_pos, n_in, n_out = (same & others).sum(1), intruding.sum(1), missed.sum(1)
        few, least = n_pos < k, np.minimum(n_in, n_out)
        return {
            "batch_size": np.full(len(scores), size), "loss_case": np.where(few, 1, 2), "n_pos": n_pos, "kth_score": kth,
            "n_intruding": n_in, "n_missed": n_out,
            "neg_part": _sum_of_least(scores, intruding, np.where(few, least, n_in)),
            "pos_part": -_sum_of_least(-scores, missed, np.where(few, n_out, least))}

    return _report(batches, "batch_size bigint, loss_case bigint, n_pos bigint, kth_score double, n_intruding bigint, "
                            "n_missed bigint, neg_part double, pos_part double", strip)


def ranked_list_score(report: DataFrame, run_case1: bool) -> DataFrame:
    """Score per batch: the anchors of one case only, divided by the full batch size."""
    wanted = F.col("loss_case") == (1 if run_case1 else 2)
    part = F.when(wanted, F.col("neg_part") - F.col("pos_part")).otherwise(0.0)
    return report.groupBy("batch_id").agg(
        F.count_if(wanted).alias("n_anchors"), (F.sum(part) / F.max("batch_size")).alias("score"))


def semihard_triplets(batches: DataFrame, margin: float) -> DataFrame:
    """Per anchor, over its positives: the hinge of positive distance + margin against the nearest negative that is
    farther than the positive, or the farthest negative when there is none. Euclidean distance of unit vectors."""

    def strip(scores, same, others, place, unit):
        square = (unit * unit).sum(1)
        dist = np.sqrt(np.maximum(square[place, None] + square[None, :] - 2 * scores, 0.0))
        # By distance, negatives first among equals: the next negative after a positive is farther.
        order = np.lexsort((same, dist), axis=1)
        ordered = np.take_along_axis(dist, order, axis=1)
        negative = np.take_along_axis(~same, order, axis=1)
        following = np.minimum.accumulate(np.where(negative, ordered, np.inf)[:, ::-1], axis=1)[:, ::-1]
        farthest = np.where(~same, dist, -np.inf).max(axis=1, initial=-np.inf)
        usable = (farthest > -np.inf)[:, None] & np.take_along_axis(same & others, order, axis=1)
        outside = usable & np.isfinite(following)
        chosen = np.where(outside, following, np.where(farthest > -np.inf, farthest, 0.0)[:, None])
        hinge = np.where(usable, np.maximum(margin + ordered - chosen, 0.0), 0.0)
        return {"n_triplets": usable.sum(1), "n_semihard": outside.sum(1), "hinge_sum": hinge.sum(1)}

    return _report(batches, "n_triplets bigint, n_semihard bigint, hinge_sum double", strip)


def triplet_score(report: DataFrame) -> DataFrame:
    return report.groupBy("batch_id").agg(
        F.sum("n_triplets").alias("n_triplets"),
        (F.sum("hinge_sum") / F.nullif(F.sum("n_triplets"), F.lit(0))).alias("score"))


def contrastive_score(pairs: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean of y d^2 + (1 - y) max(margin - d, 0)^2 over (left_vec, right_vec, is_same)."""
    d = euclidean(F.col("left_vec"), F.col("right_vec"))
    gap = F.greatest(F.lit(margin) - F.col("d"), F.lit(0.0))
    term = F.when(F.col("is_same") == 1, F.col("d") * F.col("d")).otherwise(gap * gap)
    return pairs.withColumn("d", d).agg(
        F.count("*").alias("n_pairs"), F.sum("is_same").cast("bigint").alias("n_same"), F.avg(term).alias("score"))
