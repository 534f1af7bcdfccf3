"""Near duplicates, repeated passages and the source mix against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkprint.llm import minhash_dedup, mixing, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size double, kept int, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1.0, 1, "x") for i, t, s in rows], SCHEMA)


def documents(seed=5):
    """Copies, near copies, shared passages, short, empty, null and repeated rows."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    base = [word() for _ in range(80)]
    passage = " ".join(word() for _ in range(12))
    rows = []
    for i in range(90):
        words = [word() for _ in range(draw.randint(5, 60))]
        if i % 3 == 0:
            words = list(base)
            for _ in range(i % 5):
                words[draw.randrange(len(words))] = word()
        elif i % 7 == 0:
            words.insert(draw.randrange(len(words)), passage)
        rows.append((i, (" " if i % 2 else "\n").join(words), f"s{i % 4}" if i % 9 else None))
    rows += [(200, "", "s0"), (201, None, "s1"), (202, " \t ", "s2"), (203, "One two", "s0"), (204, "one\ttwo ", None),
             (205, rows[0][1].upper(), "s3"), (None, rows[0][1], "s0"), (None, None, None), (3, rows[3][1], "s3"),
             (206, " ".join(base) * 40, "s1")]
    return rows


def sets(text):
    w = bytes(text or "", "utf-8").lower().split()
    if not w:
        return frozenset()
    return frozenset([b" ".join(w)]) if len(w) < 5 else frozenset(b" ".join(w[i:i + 5]) for i in range(len(w) - 4))


def near_brute(rows):
    found = [sets(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if found[a] and found[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(found[a] & found[b])
                if 100 * both >= 75 * (len(found[a]) + len(found[b]) - both):
                    parent[root(a)] = root(b)
    least = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(found[x]), least[root(x)] if i is not None else None, i is None or i == least[root(x)])
            for x, (i, *_) in enumerate(rows)]


@pytest.mark.parametrize("pairs", [16, 0])
def test_near_duplicates(spark, monkeypatch, pairs):
    """With 0 pairs per member, every bucket with several components is split by finer keys."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", pairs)
    rows = documents()
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(near_brute(rows), key=str)


def test_linked_texts_are_not_compared_again(spark, monkeypatch):
    """Finer keys give the buckets of a group new leaders; only texts outside the leader's component meet them."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", 0)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]

    def changed(times):
        words = list(base)
        for _ in range(times):
            words[draw.randrange(len(words))] = f"x{draw.random()}"
        return " ".join(words)

    rows = [(i, changed(2 if i % 2 else 6), None) for i in range(60)]
    parent, again, rounds, confirm = {}, [], [], minhash_dedup._confirmed

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def watched(pairs, texts):
        found = confirm(pairs, texts)
        met = [(bytes(r.a), bytes(r.b), r.ok) for r in found.collect()]
        again.extend((a, b) for a, b, _ in met if root(a) == root(b))
        for a, b, ok in met:
            if ok:
                parent[root(a)] = root(b)
        rounds.append(len(met))
        return found

    monkeypatch.setattr(minhash_dedup, "_confirmed", watched)
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(near_brute(rows), key=str)
    assert len(rounds) > 2 and not again


def test_texts_near_the_threshold_of_a_large_group(spark, monkeypatch):
    """Copies that do not reach the threshold get few further keys and few comparisons, not some hundred each."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", 2)
    draw = random.Random(7)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(7)]

    def changed(times):
        words = list(base)
        for _ in range(times):
            words[draw.randrange(len(words))] = f"x{draw.random()}"
        return " ".join(words + passage * draw.randrange(2))

    rows = [(i, changed(i % 3 if i % 2 else 5), None) for i in range(240)]
    keys, pairs, confirm, members = [], [], minhash_dedup._confirmed, minhash_dedup._members
    around = minhash_dedup._around_pivots

    def confirmed(*args):
        found = confirm(*args)
        pairs.append(found.count())
        return found

    def further(*args):
        made = around(*args)
        keys.append(made.count())
        return made

    def longer(signed):
        if "component" in signed.columns:
            keys.append(signed.select(F.explode("bands")).count())
        return members(signed)

    monkeypatch.setattr(minhash_dedup, "_confirmed", confirmed)
    monkeypatch.setattr(minhash_dedup, "_around_pivots", further)
    monkeypatch.setattr(minhash_dedup, "_members", longer)
    got = minhash_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(near_brute(rows), key=str)
    assert len(keys) > 0 and sum(keys) < 20 * len(rows) and sum(pairs) < 10 * len(rows), (keys, pairs)


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_min_max_bands_estimate_similarity():
    draw = random.Random(1)
    a = [str(draw.random()) for _ in range(400)]
    keys = [minhash_dedup.band_keys(minhash_dedup.shingles(" ".join(x).encode(), 1), 2000, 1, 9)
            for x in (a, a[:350] + [str(draw.random()) for _ in range(50)])]
    assert abs((keys[0] == keys[1]).mean() - 350 / 450) < 0.03


def repeats_brute(rows, n):
    first = {}
    texts = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t, _ in rows]
    for i, b in texts:
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (shown, *_) in zip(texts, rows):
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < i:
                gone[p:p + n] = [True] * n
        spans, at = [], 0
        while at < len(b):
            end = at
            while end < len(b) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out.append((shown, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize(("window", "hot", "chunk"), [(12, 4096, 2 << 20), (12, 1, 700), (50, 4096, 700), (50, 2, 700)])
def test_repeated_windows_go(spark, window, hot, chunk):
    """With small chunks every copy meets others in the sort; a low `hot` deals anchors out by their whole windows."""
    rows = documents()
    got = suffix_dedup.remove_repeats(frame(spark, rows), window=window, hot_chunks=hot, chunk_bytes=chunk, bucket_bytes=2000)
    found = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(repeats_brute(rows, window), key=str)


def test_whole_characters_and_other_columns(spark):
    rows = [(1, "é" * 30 + "a", "s"), (2, "x" + "é" * 30, None), (3, "ab", "s")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 20, keep=["text", "source", "size"],
                                                            whole_characters=True).collect()}
    assert got[2].kept.decode() == "x" and got[2].c0 == rows[1][1] and got[2].c1 is None and got[2].c2 == 1.0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_mix_reaches_targets(spark):
    docs = frame(spark, documents())
    mixture = mixing.mix(docs, block_words=8)
    rows = mixing.taken(mixture).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t, _ in documents())
    assert all(r.taken <= 2 * r.size for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    assert all(abs(n - target) <= 8 and target <= 2 * size for (size, target), n in by.items())
    again = mixing.taken(mixing.mix(docs.repartition(3), block_words=8))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.taken(mixing.mix(frame(spark, []))).count() == 0
    spread = mixture.stream.groupBy("source_no").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert len(spread) > 2


def test_mixed_documents_have_the_words_taken(spark):
    rows = documents()
    docs = frame(spark, rows)
    mixture = mixing.mix(docs, block_words=8)
    want = Counter()
    for r in mixing.taken(mixture).collect():
        want[r.doc_id] += r.taken
    got, texts = Counter(), {i: t for i, t, _ in rows}
    for r in mixing.mixed_documents(docs, mixture).collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.doc_id is None or r.text in texts[r.doc_id]
    assert +want == +got


def test_hashes_in_blocks_equal_hashes_at_once():
    import numpy as np

    from inkprint.llm import common

    data = np.frombuffer(hashlib.sha512(b"x").digest() * 20_000, np.uint8)
    whole = common.window_hashes(data, 50)
    for at in (0, common.BLOCK - 3, common.BLOCK, len(whole) - 1):
        assert whole[at] == common.window_hashes(data[at:at + 50], 50)[0]


def test_anchors_spread_over_buckets():
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, 60_000).astype(np.uint8)
    runs = suffix_dedup.find_runs(data, np.array([len(data)]), 50)
    counts = np.bincount(suffix_dedup.bucket_of(runs.hash, 4), minlength=4)
    assert counts.min() > 0.2 * counts.sum() and len(runs.at) < len(data) / 8
