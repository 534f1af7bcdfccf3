import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkprint.operators import intervals, pairs, verification

SCHEMA = "id bigint, label bigint, vec array<double>"
METRICS = pairs.SIMILARITIES + pairs.DISTANCES


def sample(seed=3, queries=37, targets=29, labels=6, dim=5):
    """Vectors with copies of each other on both sides, so that pairs tie within and across the classes."""
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(12, dim)) / 4
    pick = lambda n: [pool[rng.integers(12)] if rng.random() < 0.4 else rng.normal(size=dim) / 4 for _ in range(n)]
    q = [(i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(pick(queries))]
    t = [(100 + i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(pick(targets))]
    return q, t


def one_score(a, b, metric):
    """The exact score of a pair, number by number."""
    def dot(x, y):
        total = 0.0
        for m, n in zip(x, y):
            total += m * n
        return total

    if metric == "cosine":
        sizes = float(np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
        return dot(a, b) / sizes if sizes else 0.0
    if metric in ("linear", "angular"):
        return dot(a, b) if metric == "linear" else min(1.0, max(-1.0, dot(a, b)))
    if metric == "chebyshev":
        return -max(abs(m - n) for m, n in zip(a, b))
    total = 0.0
    for m, n in zip(a, b):
        total -= (m - n) * (m - n) if metric == "euclidean" else abs(m - n)
    return total


def brute(q, t, metric):
    """Rows at the same-author scores, and sums of the other pairs between them."""
    trials = [(one_score(v, w, metric), ql == tl) for _, ql, v in q for _, tl, w in t]
    bounds = sorted({s for s, same in trials if same})
    want = {s: [0, 0] for s in bounds}
    for s, same in trials:
        if same:
            want[s][0] += 1
        elif s in want:
            want[s][1] += 1
        else:
            above = [b for b in bounds if b > s]
            at = np.nextafter(above[0], -np.inf) if above else np.nextafter(bounds[-1], np.inf)
            want.setdefault(float(at), [0, 0])[1] += 1
    return want


def frames(spark, q, t):
    return spark.createDataFrame(q, SCHEMA), spark.createDataFrame(t, SCHEMA)


@pytest.mark.parametrize("metric", METRICS)
def test_counts_equal_plain_loops(spark, metric):
    q, t = sample()
    found = intervals.interval_counts(*frames(spark, q, t), metric=metric)
    assert {r.score: [r.pos, r.neg] for r in found.collect()} == brute(q, t, metric)


def test_blocks_chunks_and_waves_do_not_matter(spark):
    q, t = sample(seed=5)
    want = brute(q, t, "cosine")
    for block, chunk, waves in ((10, 7, 1), (64, 20, 3)):
        found = intervals.interval_counts(*frames(spark, q, t), block_rows=block, chunk_keys=chunk, wave_chunks=waves)
        assert {r.score: [r.pos, r.neg] for r in found.collect()} == want


def test_hot_label_is_cut_into_blocks(spark):
    q, t = sample(seed=6, queries=60, targets=50)
    q, t = ([(i, 0 if i % 3 else l, v) for i, l, v in side] for side in (q, t))
    found = intervals.same_author_scores(*frames(spark, q, t), block_rows=8)
    want = {}
    for _, ql, v in q:
        for _, tl, w in t:
            if ql == tl:
                s = one_score(v, w, "cosine")
                want[s] = want.get(s, 0) + 1
    assert {r.score: r.pos for r in found.collect()} == want


@pytest.mark.parametrize("metric", METRICS)
def test_estimates_stay_within_their_bound(metric):
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(40, 300)) * 7, rng.normal(size=(30, 300))
    t[:10] = q[:10] * (1 + 1e-14)
    estimate, slack = intervals.estimated_closeness(q, t, metric)
    rows, columns = np.indices(estimate.shape).reshape(2, -1)
    exact = intervals._exact_pairs(q, t, rows, columns, metric)
    assert np.abs(estimate.ravel() - exact).max() <= slack


def test_scores_near_a_bound_are_computed_exactly(monkeypatch):
    """Neighbouring doubles on both sides of a bound are told apart although an estimate cannot."""
    x = 0.7
    t = np.array([[x], [np.nextafter(x, 1)], [np.nextafter(x, 0)], [0.1]])
    monkeypatch.setattr(intervals, "PAIR_VALUES", 2)
    counts = intervals._Between(np.array([x]), None, True, "linear")
    counts.add(np.ones((1, 1)), t, np.ones((1, 4), bool))
    got = {r["score"]: r["neg"] for r in counts.result().to_pylist()}
    assert got == {x: 1, np.nextafter(x, 1): 1, np.nextafter(x, 0): 2}
    later = intervals._Between(np.array([0.9]), x, True, "linear")  # a later wave leaves out what is not above its floor
    later.add(np.ones((1, 1)), t, np.ones((1, 4), bool))
    assert later.result().to_pylist() == [{"score": np.nextafter(0.9, 0), "pos": 0, "neg": 1}]


def test_metrics_without_a_grid(spark):
    """Scores closer than the grid are no ties: the exact area is 1, the rounded one a half."""
    q = [(0, 1, [1.0])]
    t = [(1, 1, [0.5 + 3e-9]), (2, 2, [0.5 + 2e-9]), (3, 2, [0.5 + 1e-9])]
    exact = verification.link_eval(*frames(spark, q, t), metric="linear").first()
    rounded = verification.link_eval(*frames(spark, q, t), metric="linear", decimals=7).first()
    assert (exact.auc_roc, exact.eer, exact.min_dcf) == (1.0, 0.0, 0.0)
    assert rounded.auc_roc == 0.5 and rounded.min_dcf == 1.0


def test_metrics_equal_those_of_all_trials(spark):
    q, t = sample(seed=8, queries=50, targets=40)
    trials = [(i, s, int(m)) for i, (s, m) in enumerate(
        (one_score(v, w, "cosine"), ql == tl) for _, ql, v in q for _, tl, w in t)]
    every = spark.createDataFrame(trials, "id bigint, score double, is_match int")
    want = verification.metrics_from_counts(verification.score_counts(every)).first()
    got = verification.link_eval(*frames(spark, q, t)).first()
    for name in ("auc_roc", "eer_v2", "min_dcf"):
        assert got[name] == pytest.approx(want[name], abs=1e-12)


def test_empty_and_one_sided_tables(spark):
    q, t = sample(queries=5, targets=5)
    left, right = frames(spark, q, t)
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left, right.withColumn("label", F.col("label") + 100))):
        assert intervals.interval_counts(a, b).count() == 0
        assert verification.link_eval(a, b).first().auc_roc is None
    alone = verification.link_eval(left.withColumn("label", F.lit(1).cast("bigint")),
                                   right.withColumn("label", F.lit(1).cast("bigint"))).first()
    assert alone.auc_roc is None
    nobody = left.withColumn("label", F.lit(None).cast("bigint"))
    assert intervals.interval_counts(nobody, right).count() == 0
    with pytest.raises(ValueError, match="unsupported metric"):
        intervals.interval_counts(left, right, "jaccard")
    with pytest.raises(ValueError, match="dense vectors"):
        intervals.interval_counts(left.drop("vec"), right.drop("vec"), "linear")


def test_trial_metrics(spark):
    rng = np.random.default_rng(4)
    rows = [(i, round(float(rng.random()), 1), int(rng.random() < 0.3)) for i in range(200)]
    trials = spark.createDataFrame(rows, "id bigint, score double, is_match int")
    got = verification.trial_metrics(trials, ["id"], p_target=0.3).first()
    curve = verification.metrics_from_counts(verification.score_counts(trials)).first()
    cost = verification.min_dcf(verification.error_rates(trials, ["id"]), ["id"], p_target=0.3).first()
    assert (got.auc_roc, got.eer, got.eer_v2) == (curve.auc_roc, curve.eer, curve.eer_v2)
    assert (got.min_dcf, got.threshold) == (cost.min_dcf, cost.threshold)
