"""Language, quality and packing: exact sums, separable cases, round trips."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from inkprint.llm import language, packing, quality

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, score double, lang_pred int"


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "bab"]
    model = language.Model(["x", "y"], language.Pieces(names), np.random.default_rng(1).random((2, len(names) + 2)))
    model.prob[:, -1] = 0
    place = {n: i for i, n in enumerate(names)}
    for word in ("▁abab", "▁bcab", "▁a", "ab"):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            ids = [place.get(p, len(names) if len(p) == 1 else len(names) + 1) for p in parts]
            want += model.prob[:, ids].prod(1)
        assert np.allclose(np.exp(model.log_scores([word])[0]), want)


@pytest.mark.parametrize("letters", [23, 30, 60])
def test_long_words_sum_all_segmentations(monkeypatch, letters):
    """Counted by the plain recursion in exact fractions, in blocks and not."""
    names = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "bab", "abababababababab"]
    model = language.Model(["x", "y"], language.Pieces(names), np.random.default_rng(2).random((2, len(names) + 2)))
    model.prob[:, -1] = 0
    word = "▁" + "".join(random.Random(letters).choice("aabbbac") for _ in range(letters - 1 - 18)) + "abababababababab" + "ba"
    place = {n: i for i, n in enumerate(names)}
    for lang in range(2):
        sums = [Fraction(1)]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[start] * Fraction(model.prob[lang, place.get(word[start:end], len(names))])
                            for start in range(max(0, end - 16), end) if end - start == 1 or word[start:end] in place))
        want = float(sums[-1])
        for block in (language.BLOCK_LETTERS, 5, 17):
            monkeypatch.setattr(language, "BLOCK_LETTERS", block)
            assert np.isclose(np.exp(model.log_scores([word])[0, lang]), want)
    uses, weight = model.expected_uses([word], np.ones((2, 1))), np.ones((2, 1))
    monkeypatch.setattr(language, "SIDE_BY_SIDE", 100)
    assert np.allclose(uses, model.expected_uses([word], weight))
    lengths = np.array([*map(len, names), 1, 0])
    assert np.allclose(uses @ lengths, len(word))  # the pieces of a segmentation cover the word


def test_fitting_on_workers_equals_fitting_at_once(spark, monkeypatch):
    texts = [("the house is on the hill " + "x" * 40, "en"), ("das haus ist auf dem berg", "de"), ("the haus", "de"), (None, "en"), ("a", None)]
    docs = spark.createDataFrame([(t, lang) for t, lang in texts * 3], "text string, lang string").repartition(3)
    counts = Counter((lang, w) for t, lang in texts * 3 if t and lang for w in language.parts_of(t))
    want = language.learn([(lang, w, n) for (lang, w), n in counts.items()], language.vocabulary(PIECES))
    got = language.fit(docs, PIECES)
    assert got.languages == want.languages and np.allclose(got.prob, want.prob)


def test_language_of_plain_texts(spark):
    rows = [(i, t, lang, 0.0, 1) for i, (t, lang) in enumerate([
        ("the house is on the hill and the river is near", "en"), ("das haus ist auf dem berg und der fluss ist nah", "de"),
        ("la maison est sur la colline et la rivière est près", "fr")] * 5)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(train, PIECES)
    tests = [(1, "The river is near the house", None, 0.0, 0), (2, "der berg und das haus", None, 0.0, 0), (3, None, None, None, None),
             (4, "12 !!", "en", 0.0, 0), (5, "", None, 0.0, 0), (6, "la rivière " * 20_000, None, 0.0, 0),
             (None, "x" * 5000, None, 0.0, 0), (1, "The river is near the house", None, 0.0, 0)]
    got = sorted(map(tuple, language.predict(spark.createDataFrame(tests, SCHEMA), model, ["doc_id", "lang"]).collect()), key=str)
    by = {r[0]: r[2:] for r in got}
    assert len(got) == 8 and by[1][0] == "en" and by[2][0] == "de" and by[6][0] == "fr"
    assert by[3] == by[4] == by[5] == ("und", 0.0) and all(0 <= r[3] <= 1 for r in got)
    nothing = spark.createDataFrame([], SCHEMA)
    assert language.predict(nothing, language.fit(nothing, PIECES), ["doc_id"]).count() == 0
    assert language.predict(train, language.fit(nothing, PIECES), ["doc_id"]).where("lang_pred = 'und'").count() == 15


def test_tokens_are_scored_alike_in_any_block(monkeypatch):
    model = language.learn([("a", "▁ab", 3), ("b", "▁cd", 4)], ["▁", "a", "b", "c", "d", "ab", "cd"])
    texts = ["ab, cd! ab", "cd-ab cd", "é", "abcd" * 30]
    want = language._sums(iter(texts), language._Scorer(model))
    monkeypatch.setattr(language, "CACHE_WORDS", 2)
    assert np.allclose(language._sums(iter(texts), language._Scorer(model), most=1), want)
    direct = np.array([model.log_scores(language.parts_of(t)).sum(0) for t in texts])
    assert np.allclose(want[:, :-1], direct)


def sample(x):
    return quality.Sample(x, np.ones(len(x), np.int64), np.arange(len(x)) % 2)


def mixture(source, positives, good, bad):
    size = quality.BINS + quality.SHAPES
    rows = [source.normal(at, 0.3, (n, size)) * (np.arange(size) < 4) for n, at in ((positives, 1), (good, 1), (bad, -1))]
    return sample(rows[0]), sample(np.vstack(rows[1:]))


def test_non_negative_risk_separates():
    positive, unlabelled = mixture(np.random.default_rng(2), 200, 400, 200)
    model = quality.learn(positive, unlabelled, 2 / 3)
    assert model.score(unlabelled.x[:400]).min() > 0.5 > model.score(unlabelled.x[400:]).max()


def test_gradient_of_the_risk_equals_differences():
    source = np.random.default_rng(4)
    p, u, weight, bias = source.normal(0.5, 1, (30, 5)), source.normal(0, 1, (40, 5)), source.normal(0, 1, 5), 0.3
    for prior in (None, 0.3, 0.9):
        for moved in (weight, weight * 0, weight * 5 + 3):
            *_, slope, lift = quality.risk_gradient(moved, bias, p, u, prior)

            def value(w, b):
                positive, negative, *_ = quality.risk_gradient(w, b, p, u, prior)
                return -negative if quality.risk_gradient(moved, bias, p, u, prior)[1] < 0 else positive + negative

            steps = [(value(moved + d, bias) - value(moved - d, bias)) / 2e-5 for d in np.eye(5) * 1e-5]
            assert np.allclose(slope, steps, atol=1e-6)
            assert np.isclose(lift, (value(moved, bias + 1e-5) - value(moved, bias - 1e-5)) / 2e-5, atol=1e-6)


def test_class_prior_needs_no_negative_label():
    for share in (0.2, 0.5, 0.8):
        positive, unlabelled = mixture(np.random.default_rng(5), 1500, int(4000 * share), 4000 - int(4000 * share))
        assert abs(quality.class_prior(positive, unlabelled) - share) < 0.06
    assert quality.class_prior(positive, unlabelled.part(2)) == quality.DEFAULT_PRIOR
    # Counts weigh as repeated rows do.
    scores, twice = np.array([0.1, 0.2, 0.8, 0.9]), np.array([2, 1, 1, 1])
    weighed = quality.mixture_share(scores[2:], twice[2:], scores, twice)
    assert np.isclose(weighed, 0.4)


def test_label_zero_and_copies_change_nothing(spark):
    rows = [(i, f"a calm line of prose number {i % 50} with words" if i % 4 else f"$$$ ### {i % 60} %%%", "en", 0.0, 0)
            for i in range(400)] + [(1000, "one page that a third of all rows hold", "en", 0.0, 0)] * 200
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ones = spark.createDataFrame([(i, 1) for i in range(0, 300) if i % 4], "doc_id bigint, quality int")
    zeros = spark.createDataFrame([(i, 0) for i in range(0, 300, 4)], "doc_id bigint, quality int")
    a, b = quality.fit(docs, ones), quality.fit(docs.repartition(7), ones.unionByName(zeros))
    assert a.prior == b.prior and np.allclose(a.weight, b.weight)


def test_quality_scores_every_text(spark):
    rows = [(i, f"a calm line of prose number {i} with ordinary words in it" if i % 4 else f"$$$ ### !!! {i} %%%", "en", 0.0, 0)
            for i in range(80)] + [(90, None, None, None, None), (91, "", "en", 0.0, 0), (None, "x" * 200_000, None, 0.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.score for r in got}
    assert min(held[i] for i in range(60, 80) if i % 4) > max(held[i] for i in range(60, 80) if not i % 4)
    nothing = quality.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing, ["doc_id"]).collect()} == {0.5}


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BPE)
    found.encode_special_tokens = True
    return found


def test_unit_wise_encoding_equals_the_library(monkeypatch):
    own, whole, draw = packing.Encoder(BPE), library(), random.Random(4)
    monkeypatch.setattr(packing, "PART", 30)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "bc", "é", "12", "!!", "日本", "'s", "<|endoftext|>", "\x1c", "\xa0", " x ", "😀"]
    for _ in range(800):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_equal_the_library_as_it_is(monkeypatch):
    own, whole, draw = packing.encoder(BPE), Tokenizer.from_file(BPE), random.Random(5)
    monkeypatch.setattr(packing, "PART", 30)
    parts = [" ", "  ", "\n", "a", " b", "é", "12", "!!", "'s", "<|endoftext|>", "<|endoftext|>", "<|end", "<|", "|>", "\xa0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    last = whole.decode([whole.get_vocab_size(with_added_tokens=False) - 1])
    for text in ["a<|endoftext|>b", "<|endoftext|>", "he" + last, *texts]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("window", "count"), [(16, 2), (64, 8)])
def test_packing_is_a_round_trip(spark, window, count):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["alpha", "béta", "gam", "d"]) for _ in range(draw.randint(0, 90))), "en", 0.0, 0) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", None, 0.0, 0), (102, "long " * 3000, None, 0.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = [r.asDict() for r in packing.pack(docs, BPE, window=window, open_windows=count).collect()]
    whole, texts = library(), {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == len(texts.get(r["doc_id"], []))
        texts.setdefault(r["doc_id"], []).extend(ids)
    assert texts == {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    sequences = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in sequences.values())
    assert packing.pack(docs.limit(0), BPE).count() == 0
