import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.functions.text import words
from inkprint.operators import features, mining, subword, tfidf

TEXTS = ["the cat sat on the mat", "The cat The dog", "dogs dogs dogs chase cats", "a b c", "",
         "mat mat sat cat", "cat dog mat sat chase"]


def test_tfidf_against_a_plain_loop(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc bigint, text string")
    model = tfidf.fit_tfidf(docs, max_terms=5)
    stop = set(tfidf.STOP_WORDS)
    tokens = [[w for w in t.split() if len(w) > 1 and w not in stop] for t in TEXTS]
    df, tf = Counter(), Counter()
    for ws in tokens:
        df.update(set(ws))
        tf.update(ws)
    chosen = sorted((t for t in df if df[t] <= 0.9 * len(TEXTS)), key=lambda t: (-tf[t], t))[:5]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in chosen}
    assert {r.term: (r.df, r.total_tf) for r in model.collect()} == {t: (df[t], tf[t]) for t in chosen}
    weights = tfidf.tfidf_weights(tfidf.term_freq(tfidf.tokens(docs, "doc"), "doc"), model, "doc")
    got = defaultdict(dict)
    for r in weights.collect():
        got[r.doc][r.term] = r.w
    for i, ws in enumerate(tokens):
        raw = {t: n * idf[t] for t, n in Counter(ws).items() if t in idf}
        size = math.sqrt(sum(x * x for x in raw.values()))
        assert got[i] == pytest.approx({t: x / size for t, x in raw.items()})
    vectors = tfidf.author_vectors(docs.select(F.col("doc").alias("label"), "text"), model).collect()
    assert {r.label for r in vectors if not r.terms} == {3, 4}  # nothing known in them, yet they stay


def ranked_list_loop(ids, labels, vectors, margin, k, case1):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    total = 0.0
    for i in range(len(ids)):
        pairs = [(float(unit[i] @ unit[j]) + (0 if labels[i] == labels[j] else margin), labels[i] == labels[j])
                 for j in range(len(ids)) if j != i]
        kth = sorted((s for s, _ in pairs), reverse=True)[k - 1]
        intruding = sorted(s for s, same in pairs if not same and s >= kth)
        missed = sorted(s for s, same in pairs if same and s < kth)
        if (sum(same for _, same in pairs) < k) != case1:
            continue
        if case1:
            total += sum(intruding[:len(missed)]) - sum(missed)
        else:
            total += sum(intruding) - sum(sorted(missed, reverse=True)[:len(intruding)])
    return total / len(ids)


@pytest.mark.parametrize("k", [2, 5])
def test_mining_against_plain_loops(spark, k):
    rng = np.random.default_rng(3)
    ids, labels, vectors = list(range(40)), rng.integers(0, 9, 40).tolist(), rng.normal(size=(40, 5))
    batch = spark.createDataFrame([(0, i, l, v.tolist()) for i, l, v in zip(ids, labels, vectors)],
                                  "batch_id bigint, id bigint, label bigint, vec array<double>")
    report = mining.ranked_list_report(batch, 0.25, k)
    for case1 in (True, False):
        got = mining.ranked_list_score(report, case1).first().score
        assert got == pytest.approx(ranked_list_loop(ids, labels, vectors, 0.25, k, case1))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dist = np.linalg.norm(unit[:, None] - unit[None, :], axis=2)
    losses = []
    for i in ids:
        neg = [dist[i, j] for j in ids if labels[j] != labels[i]]
        for j in ids:
            if j != i and labels[j] == labels[i]:
                outside = [d for d in neg if d > dist[i, j]]
                losses.append(max(0.0, 0.2 + dist[i, j] - (min(outside) if outside else max(neg))))
    row = mining.triplet_score(mining.semihard_triplets(batch, 0.2)).first()
    assert row.n_triplets == len(losses) and row.score == pytest.approx(np.mean(losses))


def test_tied_kth_score(spark):
    v = [1.0, 0.0]
    batch = spark.createDataFrame([(0, i, i % 2, v) for i in range(6)], "batch_id bigint, id bigint, label bigint, vec array<double>")
    row = mining.ranked_list_report(batch, 0.0, 3).first()
    assert row.kth_score == 1.0 and row.n_intruding == 3 and row.n_missed == 0


def test_batches_larger_than_one_strip(spark):
    """5,000 vectors in a batch, scored in several strips; some anchors against plain loops."""
    rng = np.random.default_rng(9)
    n, k, vectors = 5000, 400, rng.normal(size=(5000, 4))
    labels = rng.integers(0, 10, n)
    batch = spark.createDataFrame([(0, i, int(labels[i]), vectors[i].tolist()) for i in range(n)],
                                  "batch_id bigint, id bigint, label bigint, vec array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    ranked = {r.anchor: r for r in mining.ranked_list_report(batch, 0.25, k).collect()}
    sums = {r.anchor: r for r in mining.anchor_report(batch, 0.25).collect()}
    hard = {r.anchor: r for r in mining.semihard_triplets(batch, 0.2).collect()}
    assert len(ranked) == len(sums) == len(hard) == n
    for i in (0, 417, 420, 2500, n - 1):
        rest = np.delete(np.arange(n), i)
        same = labels[rest] == labels[i]
        score = unit[rest] @ unit[i] + 0.25 * ~same
        kth = np.sort(score)[-k]
        intruders, missed = np.sort(score[~same & (score >= kth)]), np.sort(score[same & (score < kth)])[::-1]
        few, least = same.sum() < k, min(len(intruders), len(missed))
        want = (intruders[:least].sum(), missed.sum()) if few else (intruders.sum(), missed[:least].sum())
        assert (ranked[i].n_intruding, ranked[i].n_missed) == (len(intruders), len(missed))
        assert (ranked[i].kth_score, ranked[i].neg_part, ranked[i].pos_part) == pytest.approx((kth, *want))
        assert (sums[i].n_pos, sums[i].n_neg) == (same.sum(), (~same).sum())
        assert (sums[i].pos_sum, sums[i].neg_sum) == pytest.approx((score[same].sum(), score[~same].sum()))
        far = np.sqrt(np.maximum(2 - 2 * (unit[rest] @ unit[i]), 0))
        negatives, loss, outside = far[~same], 0.0, 0
        for d in far[same]:
            later = negatives[negatives > d]
            outside += bool(len(later))
            loss += max(0.0, 0.2 + d - (later.min() if len(later) else negatives.max()))
        assert (hard[i].n_triplets, hard[i].n_semihard) == (same.sum(), outside)
        assert hard[i].hinge_sum == pytest.approx(loss, abs=1e-6)


def test_contrastive(spark):
    pairs = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0], 1), ([0.0], [0.5], 0), ([0.0], [2.0], 0)],
                                  "left_vec array<double>, right_vec array<double>, is_same int")
    row = mining.contrastive_score(pairs).first()
    assert (row.n_pairs, row.n_same) == (3, 1) and row.score == pytest.approx((25 + 0.25 + 0) / 3)


def test_ngrams_and_pooling(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "x"), (3, "")], "id bigint, t string")
    got = {r.id: r.g for r in rows.select("id", features.ngram_buckets(words(F.col("t")), 1 << 30).alias("g")).collect()}
    assert len(got[1]) == 4 + 3 + 2 and got[2] == [] and got[3] == []
    members = spark.createDataFrame([(1, [0, 2]), (1, [2]), (1, [])], "e bigint, features array<int>")
    pooled = features.pool_posts(members, ["e"])
    assert {r.feature: r.mean_value for r in pooled.collect()} == pytest.approx({0: 1 / 3, 2: 2 / 3})
    vec = features.episode_vectors(pooled, ["e"], 4).first().vec
    want = np.array([1, 0, 1, 0, 1 / 3, 0, 2 / 3, 0])
    assert vec == pytest.approx((want / np.linalg.norm(want)).tolist())
    dense = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 1.0])], "e bigint, vec array<double>")
    assert features.pool_vectors(dense, ["e"]).first().vec == [3.0, 5.0, 2.0, 3.0]
    both = spark.range(1).select(features.post_features(F.array(F.lit(1)), F.lit(2), F.lit(30), 5, 8).alias("with_action"),
                                 features.post_features(F.array(F.lit(1)), None, F.lit(3), 5, 8).alias("text_time")).first()
    assert both.with_action == [1, 10] and both.text_time == [1, 11]


CORPUS = ["low lower lowest new newer newest wide wider widest"] * 20 + ["the lowest newer wide river été 日本"] * 10


def test_subword_vocabulary(spark):
    lines = spark.createDataFrame(list(enumerate(CORPUS)), "id bigint, text string")
    fitted = subword.fit_subword_vocab(lines, "text", 60)
    table = {r.piece: r.piece_id for r in fitted.collect()}
    assert len(table) <= 60 and sorted(table.values()) == list(range(len(table)))
    assert (table["<pad>"], table["</s>"], table["<unk>"]) == (0, 1, 2)
    assert set("".join(CORPUS).replace(" ", "")) | {subword.MARK} <= set(table)
    assert any(len(p) > 3 for p in table if p not in subword.RESERVED)
    texts = spark.createDataFrame([(1, "lowest  newer\nwide"), (2, ""), (3, "low xyzq low")], "id bigint, text string")
    encoded = subword.encode_posts(texts, fitted, "text")
    back = {r.id: r.text for r in subword.decode_posts(encoded, fitted, "id").collect()}
    assert back[1] == "lowest newer wide" and back[2] == ""
    assert back[3] == "low <unk> low"
    assert all(len(r.syms) <= 2 for r in subword.encode_posts(texts, fitted, "text", 2).collect())


def test_expected_uses_agree_in_both_forms():
    scores = {p: math.log(x) for p, x in {"a": 0.3, "b": 0.2, "ab": 0.25, "ba": 0.15, "aba": 0.1}.items()}
    plain, logs = defaultdict(float), defaultdict(float)
    chances = {p: math.exp(s) for p, s in scores.items()}
    assert subword._expected_uses("abaab", chances, 3, plain, 2.0)
    subword._expected_uses_log("abaab", scores, 3, logs, 2.0)
    assert dict(plain) == pytest.approx(dict(logs))
    assert not subword._expected_uses("ab" * 2000, chances, 3, plain, 1.0)
    assert sum(len(p) * n for p, n in logs.items()) == pytest.approx(2.0 * 5)


def test_vectorised_expectation_equals_the_word_by_word_one():
    import numpy as np

    from inkprint.functions.lattice import Pieces, by_length, expected_uses

    names = ["a", "b", "ab", "ba", "aba", "bb"]
    scores = {p: -1.0 - 0.3 * i for i, p in enumerate(names)}
    chances, uses = {p: math.exp(s) for p, s in scores.items()}, defaultdict(float)
    words, weight = ["abaab", "b", "abbab", "ba"], np.array([2.0, 1.0, 3.0, 5.0])
    for w, n in zip(words, weight):
        assert subword._expected_uses(w, chances, 3, uses, n)
    pieces, got = Pieces(names), np.zeros(len(names) + 1)
    for group in by_length(words):
        expected_uses(pieces.arcs([words[i] for i in group]), np.append(list(chances.values()), 0.0), weight[group], got)
    assert np.allclose(got[:-1], [uses[p] for p in names])


def test_best_cuts_equal_the_word_by_word_ones(spark):
    """Ties, uncovered letters and pieces of all lengths; then through the encoder, long words included."""
    import random

    from inkprint.functions.lattice import Pieces, best_cuts

    draw = random.Random(4)
    scores = {"".join(draw.choices("abc", k=draw.randint(1, 5))): -float(draw.randint(1, 4)) for _ in range(40)}
    names = list(scores)
    for n in (1, 2, 7, 12):
        words = ["".join(draw.choices("abcd", k=n)) for _ in range(50)]
        cuts = best_cuts(Pieces(names).arcs(words), np.append(list(scores.values()), -np.inf), -9.0)
        for word, cut in zip(words, cuts):
            assert [None if i == len(names) else names[i] for i in cut] == subword.best_split(word, scores, 5, -9.0)[0]


def test_bucket_digits_do_not_change_buckets(spark):
    from inkprint.functions.text import md5_bucket

    words = F.array(*[F.lit(w) for w in "the cat sat on the mat and the cat ran".split()])
    for buckets in (1, 2, 16, 64, 100, 4096):
        got, want = spark.range(1).select(
            features.ngram_buckets(words, buckets, (2,)),
            F.array_distinct(F.transform(F.zip_with(F.slice(words, 1, 9), F.slice(words, 2, 9), lambda a, b: F.concat(a, F.lit(" "), b)),
                                         lambda g: md5_bucket(g, buckets).cast("int")))).first()
        assert got == want, buckets
