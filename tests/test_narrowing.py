import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkprint.operators import intervals, narrowing, pairs, verification
from inkprint.operators.narrowing import Ranges, every_head, keys_of

SCHEMA = "id bigint, label bigint, vec array<double>"


def sides(spark, seed=3, queries=60, targets=50, labels=4, dim=5, copies=0.3):
    """Vectors with copies of each other on both sides, near their label's centre."""
    rng = np.random.default_rng(seed)
    centres, pool = rng.normal(size=(labels, dim)), rng.normal(size=(6, dim))
    out = []
    for first, n in ((0, queries), (1000, targets)):
        label = rng.integers(labels, size=n)
        vecs = [pool[rng.integers(6)] if rng.random() < copies else centres[x] / 3 + rng.normal(size=dim) / 2 for x in label]
        out.append(spark.createDataFrame([(first + i, int(x), v.tolist()) for i, (x, v) in enumerate(zip(label, vecs))], SCHEMA))
    return out


def test_keys_follow_the_order_of_doubles():
    x = np.array([-np.inf, -2.0, -1.0, -1e-300, 0.0, 1e-300, 0.5, np.nextafter(0.5, 1), 1.0, np.inf, np.nan])
    keys = keys_of(x)
    assert (np.diff(keys) > 0).all() and keys_of(np.array([-0.0]))[0] == keys_of(np.array([0.0]))[0]
    slots = every_head().slot(keys)
    assert (np.diff(slots) >= 0).all() and slots.min() >= 0


def test_slots_of_ranges_and_gaps():
    low, high = keys_of(np.array([0.5, 2.0]))
    ranges = Ranges(np.array([low, high]), np.array([46, 48]), np.array([4, 1]))
    found = ranges.slot(keys_of(np.array([0.1, 0.5, 0.51, 0.531, 1.0, 2.0, 9.0])))
    assert found[1] == 0 and found[1] <= found[2] <= 3 and found[5] == 4
    assert found[0] < 0 and found[4] < 0 and found[6] < 0 and len({found[0], found[4], found[6]}) == 3
    keys = keys_of(np.random.default_rng(0).uniform(-3, 3, 1000))
    a, b = ranges.between(keys, keys)
    assert (a == b).all() and (a[a >= 0] == ranges.slot(keys)[a >= 0]).all()


@pytest.mark.parametrize("metric", pairs.SIMILARITIES + pairs.DISTANCES)
def test_rounded_metrics_are_those_of_all_scores(spark, metric):
    left, right = sides(spark)
    want = verification.link_eval(left, right, metric).first()
    got = narrowing.link_metrics(left, right, metric, places=3, slots=1 << 12, listed=1000).first()
    assert [round(x, 3) for x in got] == [round(x, 3) for x in want]
    assert (got.eer, got.eer_v2) == (want.eer, pytest.approx(want.eer_v2, abs=1e-12))


def test_folded_slots_know_more_of_their_wins():
    rng = np.random.default_rng(2)
    pos, neg = rng.integers(0, 5, size=(2, 64))
    fine = narrowing._state(np.arange(64) << 3, np.full(64, 3), pos, neg)
    folded = narrowing._folded(fine, 2)
    a, b = (narrowing.Bracket(x[::-1], (0.01, 1.0, 1.0)).area() for x in (fine, folded))
    assert a == pytest.approx(b, abs=1e-12)
    coarse = narrowing._state(folded["start"], folded["shift"], folded["pos"], folded["neg"])
    wider = narrowing.Bracket(coarse[::-1], (0.01, 1.0, 1.0)).area()
    assert wider[0] < a[0] < a[2] < wider[2]
    coarse = narrowing._finer(coarse, folded[5:])
    assert (coarse["gain"][5:] == folded["gain"][5:]).all() and not coarse["gain"][:5].any()


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_waves_hold_every_slot_once(bits):
    ranges = Ranges(np.array([0, 4]) << 48, np.array([40, 44]), np.array([256, 16]))
    waves = narrowing._waves(ranges, bits, 64)
    starts = np.concatenate([w.parts(np.arange(0, w.total, 1 << bits))[0] for w in waves])
    assert sorted(starts.tolist()) == ranges.parts(np.arange(272))[0].tolist()
    assert max(w.total for w in waves) <= 128 and all(w.total % (1 << bits) == 0 for w in waves)


def test_scores_do_not_leave_the_cells(spark, monkeypatch):
    """One label: same-author scores are quadratic in the vectors, but none is written and few are listed."""
    left, right = (s.withColumn("label", (F.rand(1) < 0.1).cast("bigint")) for s in sides(spark, copies=0.0))
    monkeypatch.setattr(intervals, "same_author_scores", None)
    listed = []
    plain = narrowing._Pairs.listed
    monkeypatch.setattr(narrowing._Pairs, "listed", lambda self, ranges: listed.append(plain(self, ranges)) or listed[-1])
    got = narrowing.link_metrics(left, right, places=2, slots=1 << 14, listed=100).first()
    assert got.auc_roc is not None and sum(len(x) for x in listed) <= 100 * len(listed)
    assert verification.link_eval(left, right, places=6).first().auc_roc is not None


def test_degenerate_sides(spark):
    left, right = sides(spark, queries=5, targets=5)
    one = [s.withColumn("label", F.lit(1).cast("bigint")) for s in (left, right)]
    for a, b in ((left.limit(0), right), (left, right.withColumn("label", F.col("label") + 100)), one):
        assert tuple(narrowing.link_metrics(a, b).first()) == tuple(verification.link_eval(a, b).first())
    zero = left.withColumn("vec", F.array(*[F.lit(0.0)] * 5))
    got, want = (verification.link_eval(zero, right, places=p).first() for p in (6, None))
    assert tuple(got) == tuple(want)
    with pytest.raises(ValueError, match="dense vectors"):
        narrowing.link_metrics(left.drop("vec"), right.drop("vec"))


def cell_of_vectors(odd=False):
    """Two sides with copies, opposite and zero vectors, missing labels; with `odd`, values that are not finite."""
    rng = np.random.default_rng(4)
    q, t = rng.normal(size=(150, 6)), rng.normal(size=(1200, 6))
    q[:20], q[20:30], t[:25], t[30:33] = q[0], -q[0], q[0], 0.0
    if odd:
        q[40, 2], t[41, 1] = np.nan, np.nan
    tables = [pa.table({"label": pa.array([None if i % 11 == 0 else int(x) for i, x in enumerate(rng.integers(0, 4, len(v)))], pa.int64())})
              for v in (q, t)]
    rows, columns = (x.ravel() for x in np.indices((len(q), len(t))))
    return q, t, narrowing._codes(*tables), intervals._exact_pairs(q, t, rows, columns, "cosine")


@pytest.mark.parametrize("odd", [False, True])
def test_even_slots_count_every_pair_once(monkeypatch, odd):
    """The slot of nearly all pairs is a whole part; no pair goes through the search among ranges as a whole tile."""
    q, t, codes, exact = cell_of_vectors(odd)
    monkeypatch.setattr(narrowing, "_between", None)
    same, every = (codes[0][:, None] == codes[1][None, :]).ravel(), narrowing.even_ranges(12)
    assert every.start[0] == -2 ** 63 and every.last[-1] == 2 ** 63 - 1 and (every.last[:-1] + 1 == every.start[1:]).all()
    low, high = keys_of(np.array([-0.4, 0.3]))
    seen = 0
    for ranges in (*narrowing._waves(every, 4, 1 << 22), *narrowing._waves(every.within(int(low), int(high)), 6, 1 << 17)):
        found = narrowing._Slots(ranges, "cosine")
        if found.even is None:
            continue
        found.open(len(exact))
        narrowing._Tiles(q, t, codes, found.bits).each(found)
        got, want = np.zeros((2, ranges.total, 2), np.int64)
        for row in found.result().to_pylist():
            n = min(narrowing.CHUNK_SLOTS, ranges.total - row["chunk"] * narrowing.CHUNK_SLOTS)
            part = got[row["chunk"] * narrowing.CHUNK_SLOTS:][:n]
            part[:, 1], part[:, 0] = narrowing._unpacked(row["pos"], n), narrowing._unpacked(row["neg"], n)
        slots = ranges.slot(keys_of(exact))
        np.add.at(want, (slots[slots >= 0], same[slots >= 0].astype(int)), 1)
        assert (got == want).all()
        seen += 1
    assert seen >= 2


@pytest.mark.parametrize("ends", [(-1e-9, 1e-9), (0.2, 0.21), (0.999, 2.0), (-5.0, -0.9999)])
def test_scores_of_ranges_are_listed(ends):
    q, t, codes, exact = cell_of_vectors()
    low, high = keys_of(np.array(ends)) >> 30
    ranges = Ranges(np.array([low << 30]), np.array([30]), np.array([high - low + 1]))
    found = narrowing._Listed(ranges, "cosine")
    found.open(len(exact))
    narrowing._Tiles(q, t, codes, found.bits).each(found)
    inside = ranges.slot(keys_of(exact)) >= 0
    same = (codes[0][:, None] == codes[1][None, :]).ravel()
    got = found.result()
    assert got["score"].to_pylist() == np.unique(exact[inside]).tolist()
    assert (sum(got["pos"].to_pylist()), sum(got["neg"].to_pylist())) == (same[inside].sum(), (~same)[inside].sum())


def test_slots_within_keys():
    ranges = narrowing.even_ranges(10)
    low, high = (int(x) for x in keys_of(np.array([-0.3, 0.7])))
    part = ranges.within(low, high)
    starts, shifts = ranges.parts(np.arange(ranges.total))
    want = (starts + ((1 << shifts) - 1) >= low) & (starts <= high)
    assert (part.parts(np.arange(part.total))[0] == starts[want]).all()
