"""Token ids against the library, runs against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkprint.llm import automaton, bpe, periodic

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, ids string, runs int, _k0 int"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_automaton_holds_all_substrings_and_no_others():
    rng = random.Random(1)
    for _ in range(50):
        words = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        made = automaton.SuffixAutomaton()
        for word in words:
            made.add(word)
        inside = {tuple(w[a:b]) for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        for size in range(1, 6):
            for _ in range(30):
                probe = tuple(rng.randrange(3) for _ in range(size))
                state = 0
                for symbol in probe:
                    state = made.step(state, symbol) if state >= 0 else -1
                assert (state >= 0) == (probe in inside)
        assert sum(made.length[s] - made.length[made.link[s]] for s in range(1, len(made.link))) == len(inside)


def test_ids_as_in_the_library(library):
    rng = random.Random(2)
    texts = ["", " ", "Hello World's 123 <|endoftext|> don't", "ΑΣ Σ ΟΔΟΣ", "İstanbul ǅ", "é é ́a", "\x1c\x1da b c\x85d",
             "</w> ab</w>", "<|startoftext|>x<|startoftext|>", "中文字符测试", "a" * 5000, "ab" * 40, "!!!???...", "😀😀", "\x00 a", "can'T 'S"]
    texts += ["".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    texts += ["".join(map(chr, rng.choices([*range(32, 127), *range(0xa0, 0x250), *range(0x370, 0x400), *range(0x4e00, 0x4e40)], k=30)))
              for _ in range(400)]
    codec = bpe.Codec(WORDS)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, np.int32).tolist()
        assert got == want, text
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_words_alone_and_side_by_side_agree():
    tokens = bpe.codec(WORDS).tokens
    words = [w.encode() for w in ("a", "strawberries", "aaaaaaa", "thethethe", "x" * 64, "qu" * 31)]
    assert [np.frombuffer(x, np.int32).tolist() for x in tokens.encode_all(words)] == [tokens.encode(w) for w in words]


def test_ids_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_LETTERS", 20)
    monkeypatch.setattr(bpe, "PAIRS", 8)
    texts = ["the house of the rising sun", "the house", "risingrising suns"] * 3
    assert bpe.Codec(WORDS).encode(texts) == bpe.codec(WORDS).encode(texts)


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "The house's 12", "x", 1, 2), (1, "The house's 12", "x", 1, 2), (2, None, None, None, None), (None, "", "y", 0, 0),
            (3, "word " * 30_000, "z", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    made = bpe.encode(docs.drop("ids"), WORDS, ["doc_id", "runs", "_k0"], decoded=True)
    got = {r.doc_id: r for r in made.collect()}
    assert made.count() == 5 and got[2].ids == got[None].ids == [] and got[2].decoded == ""
    assert got[1].ids == library.encode("The house's 12", add_special_tokens=False).ids and len(got[3].ids) == 30_000
    back = bpe.decode(made.select("doc_id", "ids", "decoded"), WORDS, ["doc_id"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, made.select("doc_id", "decoded").collect()), key=str)
    odd = spark.createDataFrame([(1, None), (2, [0, None, 999_999, 1])], "id int, ids array<int>")
    assert sorted(map(tuple, bpe.decode(odd, WORDS, ["id"]).collect())) == [(1, None), (2, '! "')]
    assert bpe.encode(docs.limit(0), WORDS, ["doc_id"]).count() == bpe.decode(odd.limit(0), WORDS, ["id"]).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def brute_runs(words, least):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        words = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(90))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randrange(1, len(words) + 1)
            words = [w if i < a else words[a + (i - a) % p if a + (i - a) % p < len(words) else a] for i, w in enumerate(words)]
        least = rng.choice([2, 3, 7, 12])
        want = brute_runs(words, least)
        assert periodic.runs_of(words, least) == want
        assert periodic.find([str(w).encode() for w in words], least) == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert periodic.collapse([b"%d" % w for w in words], want) == b" ".join(b"%d" % w for i, w in enumerate(words) if i not in gone)


def test_previous_ends_of_all_strings():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(25)]
        made = automaton.SuffixAutomaton()
        states = made.add(words)
        ends = periodic.LastEnds(made)
        for i, state in enumerate(states):
            segments = sorted(set(ends.access(state, i)))
            for size in range(1, i + 2):
                before = [e for e in range(size - 1, i) if words[e - size + 1:e + 1] == words[i - size + 1:i + 1]]
                colour = next((e for h, e in segments if h >= size), None)
                assert colour == (before[-1] if before else None)


def test_runs_of_a_table(spark):
    rows = [(1, "a b " * 6, "x", 1, 2), (1, "a b " * 6, "x", 1, 2), (2, None, None, None, None), (None, " \t\n", "y", 0, 0),
            (3, "w\u00a0w " * 5, "z", 1, 1), (4, "x " * 50_000 + "y", "z", 1, 1)]
    made = periodic.find_runs(spark.createDataFrame(rows, DOCS).drop("runs"), ["doc_id", "_k0", "ids"])
    got = {r.doc_id: r for r in made.collect()}
    assert made.count() == 6 and tuple(got[1].runs[0]) == (0, 12, 2) and got[1].collapsed == "a b"
    assert got[2].n_words == got[None].n_words == 0 and got[2].collapsed == "" and not got[2].runs
    assert got[3].n_words == 5 and not got[3].runs and got[4].collapsed == "x y" and tuple(got[4].runs[0]) == (0, 50_000, 1)
    assert periodic.find_runs(made.limit(0), ["doc_id"], "collapsed").count() == 0
