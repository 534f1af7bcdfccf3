"""Collocations against brute force, with and without pruning."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from inkprint.llm import collocation

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, rank int, k int"


def brute(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {(p[i:j], a) for p, a in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        kept = []
        for p, a in some.items():
            if (p, a) not in held:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(rng, n):
    """Words of very unequal frequency, with fixed phrases among them."""
    fixed = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(9)) for _ in range(rng.randrange(2, 7))) for _ in range(25)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(40):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else "w" + str(int(rng.paretovariate(0.8))))
        out.append(("".join(w + rng.choice([" ", " ", " ", " \t", ", ", ".\n"]) for w in words).title(), rng.choice(["en", "en", "de", None])))
    return out


def mined(spark, rows, **limits):
    docs = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, collocation.mine(docs, **limits).collect()))


def test_all_candidates(spark):
    rows = [*texts(random.Random(1), 120), (None, "en"), ("", None), ("Ä b Ä b", "fr"), (". ? !", "fr")]
    assert mined(spark, rows, least=6, longest=5, top=2000) == brute(rows, 6, 5, 2000)


def test_pruned_growth_gives_the_same_first_rows(spark):
    rows = texts(random.Random(2), 150)
    want = brute(rows, 5, 4, 8)
    assert mined(spark, rows, least=5, longest=4, top=8) == want and max(r[1] for r in want) == 8


def test_full_filters_only_cost_work(spark, monkeypatch):
    def full(rows):
        rows.count()
        return {role: np.full(1 << (collocation.BITS - 3), 255, np.uint8) for role in collocation.ROLES}

    monkeypatch.setattr(collocation, "_filters", full)
    rows = texts(random.Random(3), 40)
    assert mined(spark, rows, least=5, longest=3, top=5) == brute(rows, 5, 3, 5)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 9 * 10**14, 10**13 + 1, 10**13 + 7)], "a bigint, n bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    score = row.select(collocation._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert score == 1000 * 10**13 * 9 * 10**14 // ((10**13 + 1) * (10**13 + 7))


def test_no_candidates(spark):
    assert mined(spark, [], least=2) == mined(spark, [("a b", "en")], least=2) == mined(spark, [(None, None)], least=1) == []
