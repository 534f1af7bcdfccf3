"""Verification metrics: same author or not, judged by a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.operators import intervals, narrowing, pairs
from inkprint.operators.prefix import buckets_for, running_sums, with_quantile_bucket, with_range_bucket
from inkprint.session import settle


def score_counts(trials: DataFrame) -> DataFrame:
    """(score, pos, neg) from (score, is_match): exact for every metric that treats equal scores alike."""
    return trials.groupBy("score").agg(
        F.sum(F.col("is_match").cast("bigint")).alias("pos"),
        F.sum(1 - F.col("is_match").cast("bigint")).alias("neg"))


def roc_curve(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Cumulative counts at every distinct score, best score first, with the `kept` flag of the corner points.

    `true_pos` and `false_pos` count pairs scored at least as high. A point is dropped as collinear when both
    counts step on to the next point exactly as they stepped to this one.
    """
    counts = settle(counts)
    placed = with_quantile_bucket(counts, "score", buckets or buckets_for(counts.count()))
    point = F.struct("pos", "neg")
    per_bucket = placed.groupBy("_bucket").agg(
        F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.max_by(point, "score").alias("head"))
    # One row per bucket from here to the broadcast.
    every = Window.partitionBy(F.lit(0))
    downward = every.orderBy(F.desc("_bucket"))
    earlier = downward.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_bucket",
        F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("op"),
        F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("on_"),
        F.lead("head").over(downward).alias("next_head"),
        F.sum("bp").over(every).alias("n_pos"), F.sum("bn").over(every).alias("n_neg"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    curve = placed.join(F.broadcast(offsets), "_bucket").select(
        "score", "pos", "neg", "n_pos", "n_neg",
        (F.col("op") + F.sum("pos").over(upto)).alias("true_pos"),
        (F.col("on_") + F.sum("neg").over(upto)).alias("false_pos"),
        F.coalesce(F.lead(point).over(inside), F.col("next_head")).alias("_next"))
    first = (F.col("true_pos") == F.col("pos")) & (F.col("false_pos") == F.col("neg"))
    corner = (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
    return curve.withColumn("kept", first | F.col("_next").isNull() | corner).drop("_next")


def roc_points(curve: DataFrame) -> DataFrame:
    """Rates at the points of the curve; divide-by-zero gives null when a class is empty."""
    return curve.withColumn("fpr", _rate("false_pos", "n_neg")).withColumn("tpr", _rate("true_pos", "n_pos"))


def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def auc_column() -> Column:
    """Area under the curve; a tie between a positive and a negative counts half."""
    below = F.col("n_neg") - F.col("false_pos")
    wins = F.sum((F.col("pos") * (2 * below + F.col("neg"))).cast("decimal(38,0)"))
    return wins.cast("double") / (2.0 * F.nullif(F.max("n_pos"), F.lit(0)) * F.nullif(F.max("n_neg"), F.lit(0)))


def eer_column(drop_collinear: bool = True) -> Column:
    """False-positive rate at the first point where it is closest to the false-negative rate."""
    gap = F.abs((1.0 - _rate("true_pos", "n_pos")) - _rate("false_pos", "n_neg"))
    order = F.struct(gap.alias("gap"), (-F.col("score")).alias("place"))
    usable = F.when(F.col("kept") if drop_collinear else F.lit(True), order)
    # The curve starts at (0, 0), whose gap of 1 comes first and wins only when no other point is closer.
    return F.when(F.min(usable)["gap"] < 1.0, F.min_by(_rate("false_pos", "n_neg"), usable)).otherwise(F.lit(0.0))


def eer_v2_column() -> Column:
    """Where the straight-line curve crosses false-negative rate = false-positive rate."""
    f1, t1 = _rate("false_pos", "n_neg"), _rate("true_pos", "n_pos")
    f0 = (F.col("false_pos") - F.col("neg")) / F.nullif(F.col("n_neg"), F.lit(0))
    t0 = (F.col("true_pos") - F.col("pos")) / F.nullif(F.col("n_pos"), F.lit(0))
    ahead = 1.0 - f0 - t0
    crossing = (ahead > 0) & (1.0 - f1 - t1 <= 0)
    return F.max(F.when(crossing, f0 + (f1 - f0) * ahead / ((f1 - f0) + (t1 - t0))))


def threshold_cost(p_target: float, c_miss: float, c_fa: float) -> Column:
    """Detection cost of rejecting everything scored at or below this row's score."""
    misses = (F.col("n_pos") - F.col("true_pos") + F.col("pos")) / F.nullif(F.col("n_pos"), F.lit(0))
    alarms = (F.col("false_pos") - F.col("neg")) / F.nullif(F.col("n_neg"), F.lit(0))
    return c_miss * misses * p_target + c_fa * alarms * (1.0 - p_target)


def min_dcf_column(p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0) -> Column:
    """Least detection cost over the distinct scores, relative to the better trivial decision. Tied pairs cannot be
    told apart by a threshold, so they are accepted or rejected together."""
    return F.min(threshold_cost(p_target, c_miss, c_fa)) / min(c_miss * p_target, c_fa * (1.0 - p_target))


def error_rates(trials: DataFrame, id_columns: list[str], buckets: int | None = None) -> DataFrame:
    """Error rates after each item in ascending score order, ties in id order: fnr = positives so far / all,
    fpr = 1 - negatives so far / all. Range buckets over (score, ids) split even a single hot score."""
    count = buckets or buckets_for(trials.count(), least=trials.sparkSession.sparkContext.defaultParallelism)
    order = ["score", *id_columns]
    placed = with_range_bucket(trials.select(*order, F.col("is_match").cast("int").alias("is_match")), order, count)
    sums = {"cum_pos": F.col("is_match"), "cum_neg": 1 - F.col("is_match")}
    running = running_sums(placed, [F.col(c) for c in order], sums, totals=True)
    return running.select(
        *order, "is_match", "cum_pos", "cum_neg",
        (F.col("cum_pos") / F.nullif(F.col("cum_pos_total"), F.lit(0))).alias("fnr"),
        (1.0 - F.col("cum_neg") / F.nullif(F.col("cum_neg_total"), F.lit(0))).alias("fpr"))


def min_dcf(rates: DataFrame, id_columns: list[str], p_target: float = 0.01, c_miss: float = 1.0,
            c_fa: float = 1.0) -> DataFrame:
    """Minimum detection cost over items, and the score at its first minimum."""
    cost = c_miss * F.col("fnr") * p_target + c_fa * F.col("fpr") * (1.0 - p_target)
    order = F.struct(cost.alias("cost"), "score", *id_columns)
    return rates.agg(
        (F.min(cost) / min(c_miss * p_target, c_fa * (1.0 - p_target))).alias("min_dcf"),
        F.min_by("score", order).alias("threshold"))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """AUC, both equal error rates and minimum detection cost in one pass over the curve."""
    return roc_curve(counts).agg(
        auc_column().alias("auc_roc"), eer_column().alias("eer"), eer_v2_column().alias("eer_v2"),
        min_dcf_column().alias("min_dcf"))


def trial_metrics(trials: DataFrame, id_columns: list[str], p_target: float = 0.01, c_miss: float = 1.0,
                  c_fa: float = 1.0) -> DataFrame:
    """All metrics of a given list of scored trials (score, is_match and ids): area and both equal error rates over the
    curve, the detection cost and its score after every item in (score, ids) order. A list of one class has no rates:
    the area and the cost are null then."""
    trials = settle(trials.select(*id_columns, "score", "is_match"))
    whole = roc_curve(score_counts(trials)).agg(
        auc_column().alias("auc_roc"), eer_column().alias("eer"), eer_v2_column().alias("eer_v2"))
    cost = min_dcf(error_rates(trials, id_columns), id_columns, p_target, c_miss, c_fa)
    one = F.lit(1).alias("_one")
    return whole.select("*", one).join(cost.select("*", one), "_one").drop("_one")


def link_eval(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
              decimals: int | None = None, places: int | None = None) -> DataFrame:
    """All queries against all targets, end to end. Without `decimals` no score is rounded, and work and memory follow
    the distinct same-author scores. `decimals` puts scores on a grid, whose size bounds both whatever the labels are.
    `places` rounds no score either; the metrics are exact when rounded to so many decimals, and what is written and
    shuffled is bounded whatever the labels are.

    The first equal error rate takes its points from the curve's corners; a stretch of other-author pairs alone is one
    line. Pairs with equal scores are accepted or rejected together."""
    if places is not None:
        return narrowing.link_metrics(queries, targets, metric, places)
    if decimals is None:
        return metrics_from_counts(intervals.interval_counts(queries, targets, metric))
    return metrics_from_counts(pairs.score_distribution(queries, targets, metric, decimals))
