import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkprint.operators import pairs, ranking, verification
from inkprint.operators.joins import fits_broadcast, hot_keys, join_dimension

RNG = np.random.default_rng(7)
QUERIES = [(i, i % 12, RNG.normal(size=6).tolist()) for i in range(40)]
TARGETS = [(100 + i, i, RNG.normal(size=6).tolist()) for i in range(12)]
SCHEMA = "id bigint, label bigint, vec array<double>"


def cosine(a, b):
    return 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)


DISTANCES = {
    "cosine": cosine,
    "euclidean": lambda a, b: np.linalg.norm(np.subtract(a, b)),
    "manhattan": lambda a, b: np.abs(np.subtract(a, b)).sum(),
    "chebyshev": lambda a, b: np.abs(np.subtract(a, b)).max(),
}


def frames(spark):
    return spark.createDataFrame(QUERIES, SCHEMA), spark.createDataFrame(TARGETS, SCHEMA)


def brute_ranks(metric):
    ranks = {}
    for q, label, v in QUERIES:
        order = sorted((round(DISTANCES[metric](v, w), 12), t, lab) for t, lab, w in TARGETS)
        ranks[q] = 1 + [lab for _, _, lab in order].index(label)
    return ranks


@pytest.mark.parametrize("metric", list(DISTANCES))
def test_true_rank(spark, metric):
    got = {r.q: r["rank"] for r in ranking.true_rank(*frames(spark), metric=metric).collect()}
    assert got == brute_ranks(metric)


def test_block_size_does_not_matter(spark):
    q, t = frames(spark)
    for rows in (1, 3, 1000):
        got = {r.q: r["rank"] for r in ranking.true_rank(q, t, block_rows=rows).collect()}
        assert got == brute_ranks("cosine")


def test_equal_vectors_tie_by_target_id(spark):
    v = [0.3, 0.1, 0.7]
    q = spark.createDataFrame([(1, 5, v)], SCHEMA)
    t = spark.createDataFrame([(10, 4, v), (11, 5, v), (12, 6, v)], SCHEMA)
    for rows in (1, 10):
        assert ranking.true_rank(q, t, block_rows=rows).first()["rank"] == 2


def test_exactly_one_target_is_required(spark):
    q, t = frames(spark)
    with pytest.raises(Exception, match="no target for author"):
        ranking.true_rank(q, t.where("label <> 3")).collect()
    with pytest.raises(Exception, match="more than one target"):
        ranking.true_rank(q, t.unionByName(t.where("label = 3").withColumn("id", F.lit(999).cast("bigint")))).collect()


def test_rank_metrics(spark):
    ranks = [1, 3, 2, 70, 9]
    row = ranking.rank_metrics(spark.createDataFrame([(r,) for r in ranks], "rank bigint"), 80).first()
    assert row.mrr == pytest.approx(np.mean([1 / r for r in ranks]))
    assert (row.mean_rank, row.min_rank, row.max_rank, row.median_rank) == (17.0, 1, 70, 3.0)
    recalls = [row[f"recall_at_{k}"] for k in ranking.RECALL_AT]
    assert recalls == sorted(recalls) and recalls[0] == 0.2 and recalls[-1] == 0.8
    assert (row.num_queries, row.num_targets) == (5, 80)
    even = ranking.rank_metrics(spark.createDataFrame([(1,), (2,), (5,), (8,)], "rank bigint")).first()
    assert even.median_rank == 3.5


def test_precomputed(spark):
    rows = [(q, t, float((q * 7 + t * 3) % 5), int(t == q % 4)) for q in range(9) for t in range(4)]
    got = {r.q: r["rank"] for r in ranking.rank_from_scores(
        spark.createDataFrame(rows, "q bigint, t bigint, distance double, is_match int")).collect()}
    for q in range(9):
        order = sorted((d, t, m) for qq, t, d, m in rows if qq == q)
        assert got[q] == 1 + [m for _, _, m in order].index(1)


def test_salted_lookup_equals_broadcast(spark):
    facts = spark.createDataFrame([(i, None if i % 7 == 0 else 0 if i % 3 else i) for i in range(300)], "id bigint, k bigint")
    dim = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 2)], "k bigint, v bigint")
    for how in ("inner", "left"):
        plain = join_dimension(facts, dim, "k", "id", how)
        salted = join_dimension(facts, dim, "k", "id", how, max_rows=5, group_rows=20)
        assert salted.columns == plain.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_hot_keys_get_salts_by_share(spark):
    """A key with a third of the rows goes to many groups, ordinary keys to one; text keys work alike."""
    facts = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"))
    for column in (F.col("k"), F.col("k").cast("string")):
        found = hot_keys(facts.withColumn("k", column), "k", group_rows=1000).collect()
        assert [str(r.k) for r in found] == ["-1"]
        assert found[0]["_salts"] == math.ceil(20_000 / max(1000, 60_000 / (4 * spark.sparkContext.defaultParallelism)))
    assert hot_keys(facts.limit(0), "k").count() == 0
    dim = facts.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = join_dimension(facts, dim, "k", "id", max_rows=5, group_rows=1000)
    assert joined.count() == 60_000 and joined.where("v <> 2 * k").count() == 0


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(100).withColumn("vec", F.array_repeat(F.lit(0.123456789), 100))
    assert fits_broadcast(wide, 100) and not fits_broadcast(wide, 99) and not fits_broadcast(wide, 100, max_bytes=50_000)


def test_nearest_and_statistics(spark):
    q, t = frames(spark)
    best = pairs.nearest_targets(q, t, 3, block_rows=4).collect()
    for i, _, v in QUERIES:
        want = [x for _, x in sorted((round(cosine(v, w), 12), tid) for tid, _, w in TARGETS)][:3]
        assert [r.t for r in sorted((r for r in best if r.q == i), key=lambda r: r["rank"])] == want
    stats = {r.q: r for r in pairs.score_statistics(q, t, block_rows=5, decimals=12).collect()}
    for i, label, v in QUERIES:
        d = [cosine(v, w) for _, _, w in TARGETS]
        assert stats[i].n_targets == 12 and stats[i].n_same_author == 1
        assert stats[i].score_sum == pytest.approx(sum(d)) and stats[i].score_min == pytest.approx(min(d))


def test_nearest_of_a_cell_with_several_tiles():
    """Tiles of one cell are merged; equal distances go by id, and repeated query rows keep their own lists."""
    rng = np.random.default_rng(12)
    scores = rng.integers(0, 4, (6, 40)).astype(float)
    q = pa.table({"id": [1, 2, 3, 3, 4, 5], "label": [0, 1, 2, 2, 3, 4]})
    t = pa.table({"id": rng.permutation(40), "label": np.arange(40)})
    cell = pairs._Nearest(7, 1.0)
    for i in range(0, 6, 3):
        strip = q.slice(i, 3)
        for j in range(0, 40, 9):
            cell.add(strip, t.slice(j, 9), scores[i:i + 3, j:j + 9])
    got = [(r["q"], r["distance"], r["t"]) for r in cell.result().to_pylist()]
    ids = t.column("id").to_numpy()
    want = [(int(q.column("id")[i].as_py()), d, int(n)) for i in range(6) for d, n in sorted(zip(scores[i], ids))[:7]]
    assert got == want
    assert pairs._Nearest(3, 1.0).result().num_rows == 0


def test_one_label_holding_most_rows(spark):
    """A hot label is spread over blocks like any other, and all of its pairs are counted."""
    rows = [(i, 0 if i % 3 else i, RNG.normal(size=4).tolist()) for i in range(90)]
    q = spark.createDataFrame(rows, SCHEMA)
    dist = pairs.score_distribution(q, q, block_rows=16).agg(F.sum("pos"), F.sum("neg")).first()
    same = sum(a[1] == b[1] for a in rows for b in rows)
    assert tuple(dist) == (same, 8100 - same)


def test_score_counts_in_tiles_and_pages(spark, monkeypatch):
    q, t = frames(spark)
    want = {}
    for _, ql, v in QUERIES:
        for _, tl, w in TARGETS:
            cell = want.setdefault(round(-cosine(v, w), 3) + 0.0, [0, 0])
            cell[int(ql != tl)] += 1
    counters = pairs._Counts(-1.0, 3)
    left = pa.table({"label": [ql for _, ql, _ in QUERIES]})
    right = pa.table({"label": [tl for _, tl, _ in TARGETS]})
    scores = np.array([[cosine(v, w) for _, _, w in TARGETS] for _, _, v in QUERIES])
    for i in range(0, 40, 7):
        counters.add(left.slice(i, 7), right, scores[i:i + 7])
    plain = {r["score"]: [r["pos"], r["neg"]] for r in counters.result().to_pylist()}
    assert plain == want
    monkeypatch.setattr(pairs._Counts, "PAGE", 4)
    monkeypatch.setattr(pairs._Counts, "MAX_PAGES", 2)
    few = pairs._Counts(-1.0, 3)
    for i in range(0, 40, 7):
        few.add(left.slice(i, 7), right, scores[i:i + 7])
    merged = {}
    for r in few.result().to_pylist():
        old = merged.setdefault(r["score"], [0, 0])
        merged[r["score"]] = [old[0] + r["pos"], old[1] + r["neg"]]
    assert merged == want
    got = {r.score: [r.pos, r.neg] for r in pairs.score_distribution(q, t, decimals=3).collect()}
    assert got == want


def test_sparse_equals_dense(spark):
    dense = RNG.random((20, 30)) * (RNG.random((20, 30)) < 0.2)
    rows = [(i, i % 4, np.nonzero(d)[0].astype(int).tolist(), d[np.nonzero(d)].tolist()) for i, d in enumerate(dense)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, terms array<int>, weights array<double>")
    got = {r.q: r for r in pairs.score_statistics(df, df, "linear", 9, block_rows=7).collect()}
    scores = dense @ dense.T
    for i in range(20):
        assert got[i].score_sum == pytest.approx(scores[i].sum(), abs=1e-6)
        assert got[i].score_max == pytest.approx(scores[i].max(), abs=1e-6)


def test_sparse_products_in_slices_and_waves(monkeypatch):
    draw = np.random.default_rng(3)
    share = np.r_[np.full(6, 0.9), np.full(60, 0.05)]
    sides = [draw.random((n, 66)) * (draw.random((n, 66)) < share) for n in (50, 41)]
    sides[0][7] = 0

    def tile(d):
        return pairs._Sparse(pa.table({"terms": [np.nonzero(x)[0].astype(np.int32) for x in d], "weights": [x[np.nonzero(x)] for x in d]}))

    want = sides[0] @ sides[1].T
    assert np.allclose(pairs.sparse_dot(*map(tile, sides)), want)
    monkeypatch.setattr(pairs, "DENSE_TERMS", 4)
    monkeypatch.setattr(pairs, "EXPANDED", 30)
    for gain in (0, 5, 1 << 40):  # single entries only, both, slices only
        monkeypatch.setattr(pairs, "DENSE_GAIN", gain)
        assert np.allclose(pairs.sparse_dot(*map(tile, sides)), want)
    nothing = pairs.sparse_dot(tile(sides[0] * 0), tile(sides[1]))
    assert nothing.shape == (50, 41) and not nothing.any()


def test_tiles_of_a_cell_merge_to_one_row_per_query(spark, monkeypatch):
    q, t = frames(spark)
    want = {r.q: r for r in pairs.score_statistics(q, t, "linear", 9).collect()}
    merge = {"n": np.add}
    made = pairs.per_query(lambda q, t, s: {"q": q.column("id").to_numpy(), "n": np.full(len(s), s.shape[1])}, merge,
                           q=pa.int64(), n=pa.int64())()
    table = pa.table({"id": np.arange(5)})
    for strip in (table.slice(0, 3), table.slice(3)):
        for width in (4, 2, 0):
            made.add(strip, table, np.zeros((strip.num_rows, width)))
    assert made.result().to_pydict() == {"q": [0, 1, 2, 3, 4], "n": [6] * 5}
    assert pairs.grid(q, t, None)[0] >= 1 and pairs._blocks(10**6, 10**6, 131_072, 8) == (8, 8)
    got = {r.q: r for r in pairs.score_statistics(q, t, "linear", 9, block_rows=5).collect()}
    assert got.keys() == want.keys() and all(got[k].n_targets == 12 == want[k].n_targets for k in got)
    assert all(abs(got[k].score_sum - want[k].score_sum) < 1e-6 and got[k].score_max == want[k].score_max for k in got)


# --- verification metrics against plain loops ---------------------------------------------------------------------


def curve_points(scores, labels):
    """Counts at distinct scores, best first."""
    values = sorted(set(scores), reverse=True)
    tps = np.array([sum(l for s, l in zip(scores, labels) if s >= v) for v in values])
    fps = np.array([sum(1 - l for s, l in zip(scores, labels) if s >= v) for v in values])
    return values, tps, fps


def brute(scores, labels):
    p, n = sum(labels), len(labels) - sum(labels)
    values, tps, fps = curve_points(scores, labels)
    wins = sum((a > b) + 0.5 * (a == b) for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y)
    keep = [i for i in range(len(values)) if i in (0, len(values) - 1)
            or tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]]
    fpr = np.r_[0, fps[keep]] / n
    tpr = np.r_[0, tps[keep]] / p
    eer = fpr[np.argmin(np.abs((1 - tpr) - fpr))]
    lo, hi = 0.0, 1.0
    all_f, all_t = np.r_[0, fps] / n, np.r_[0, tps] / p
    for _ in range(60):  # bisection on 1 - x - tpr(x)
        mid = (lo + hi) / 2
        if 1 - mid - np.interp(mid, all_f, all_t) > 0:
            lo = mid
        else:
            hi = mid
    return {"auc": wins / (p * n), "kept": [values[i] for i in keep], "eer": eer, "eer_v2": (lo + hi) / 2}


def brute_min_dcf(scores, labels, ids):
    order = sorted(range(len(scores)), key=lambda i: (scores[i], ids[i]))
    p, n, cp, cn, best, at = sum(labels), len(labels) - sum(labels), 0, 0, float("inf"), None
    for i in order:
        cp, cn = cp + labels[i], cn + 1 - labels[i]
        cost = cp / p * 0.01 + (1 - cn / n) * 0.99
        if cost < best:
            best, at = cost, scores[i]
    return best / 0.01, at


@pytest.mark.parametrize("levels", [4, 30, 10_000])
def test_metrics_match_plain_loops(spark, levels):
    rng = np.random.default_rng(levels)
    labels = (rng.random(300) < 0.3).astype(int).tolist()
    scores = [round(float(np.floor((rng.random() + 0.3 * l) * levels) / levels), 6) for l in labels]
    trials = spark.createDataFrame(list(zip(range(300), scores, labels)), "id bigint, score double, is_match int")
    want = brute(scores, labels)
    curve = verification.roc_curve(verification.score_counts(trials), buckets=5)
    row = curve.agg(verification.auc_column().alias("auc"), verification.eer_column().alias("eer"),
                    verification.eer_v2_column().alias("eer_v2"), verification.min_dcf_column().alias("dcf")).first()
    assert row.auc == pytest.approx(want["auc"])
    assert row.eer == pytest.approx(want["eer"])
    assert row.eer_v2 == pytest.approx(want["eer_v2"], abs=1e-9)
    assert row.dcf <= 1.0 + 1e-12
    assert sorted((r.score for r in curve.where("kept").collect()), reverse=True) == want["kept"]
    dcf = verification.min_dcf(verification.error_rates(trials, ["id"], buckets=6), ["id"]).first()
    assert dcf.min_dcf == pytest.approx(brute_min_dcf(scores, labels, list(range(300)))[0])
    assert dcf.threshold == brute_min_dcf(scores, labels, list(range(300)))[1]
    if levels == 10_000 and len(set(scores)) == 300:
        assert row.dcf == pytest.approx(dcf.min_dcf)
    flipped = trials.withColumn("score", -F.col("score"))
    back = verification.roc_curve(verification.score_counts(flipped)).agg(verification.auc_column()).first()[0]
    assert row.auc + back == pytest.approx(1.0)


def test_metric_edges(spark):
    def metrics(rows):
        return verification.metrics_from_counts(verification.score_counts(
            spark.createDataFrame(rows, "score double, is_match int"))).first()

    equal = metrics([(0.5, 1), (0.5, 0), (0.5, 0)])
    assert equal.auc_roc == 0.5 and equal.eer == 0.0 and equal.eer_v2 == pytest.approx(0.5)
    perfect = metrics([(0.9, 1), (0.1, 0), (0.2, 0)])
    assert perfect.auc_roc == 1.0 and perfect.eer_v2 == 0.0 and perfect.min_dcf == 0.0
    for rows in ([(0.1, 0), (0.2, 0)], [(0.1, 1), (0.2, 1)]):
        assert metrics(rows).auc_roc is None


def test_a_cell_of_the_grid_is_small(spark):
    """A block of vectors and a tile of scores leave room for several workers in one executor; long rows share fewer."""
    from inkprint.operators import pairs

    rows = spark.range(300_000).selectExpr("id", "array_repeat(1D, 64) vec")
    left, right, _ = pairs.grid(rows, rows, None)
    assert 300_000 * 64 * 8 / min(left, right) <= 16 << 20 and pairs.TILE_ROWS ** 2 * 8 <= 8 << 20
