"""Exact top-k and embedding near duplicates against brute force."""

import math
import random

import pytest
from pyspark.errors import SparkRuntimeException

from inkprint.llm import embedding_dedup, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def vectors(n=240, dim=8, seed=3):
    draw = random.Random(seed)
    rows, base = [], [draw.gauss(0, 1) for _ in range(dim)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            v = list(base)  # copies
        elif kind == 1:
            v = [x + draw.gauss(0, 0.2) for x in base]
        else:
            v = [draw.gauss(0, 1) for _ in range(dim)]
        rows.append((i, v, i % 3, 0.5))
    rows += [(n, None, 0, 0.0), (n + 1, [0.0] * dim, None, None), (n + 2, [float("nan")] + [1.0] * (dim - 1), 0, 0.0),
             (n + 3, [None] + [1.0] * (dim - 1), 0, 0.0), (n + 4, [float("inf")] * dim, 0, 0.0), (n + 5, [], 0, 0.0),
             (n + 6, [1.0, 2.0], 0, 0.0), (None, list(base), 0, 0.0), (0, list(base), 0, 0.0)]
    return rows


def stored(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def exact(spark, rows):
    return [tuple(r)[:2] for r in stored(spark, rows).collect()]  # as 32-bit floats


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(spark):
    rows = exact(spark, vectors())
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    table = topk.whole_vectors(stored(spark, vectors()), "vec_id", "embedding", 1024)
    got = topk.top_k(table, table.where("id % 20 = 0"), k=5, n_pivots=4, rings=6, cell_rows=16)
    want = []
    for q, a in {(q, tuple(a)) for q, a in whole}:
        if q % 20 == 0 and a:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_with_repeated_query_rows(spark):
    draw = random.Random(5)
    rows = [(i, [100 + draw.randint(-40, 40) for _ in range(6)]) for i in range(1, 120)]
    rows += [(0, [150 + i, 151, 152, 153, 154, 155]) for i in range(8)] + [(0, [150] * 6)] * 3  # above all other scores
    table = spark.createDataFrame(rows, "id bigint, vec array<bigint>").coalesce(2)
    got = topk.top_k(table, table.where("id in (0, 60)"), k=5, n_pivots=2, rings=2, cell_rows=1000)
    want = []
    for q, a in {(q, tuple(a)) for q, a in rows if q in (0, 60)}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_with_few_rows_or_none(spark):
    table = topk.whole_vectors(stored(spark, [(0, [1.0, 0.0], 0, 0.0), (7, [0.5, 0.5], 0, 0.0)]), "vec_id", "embedding", 1024)
    assert [tuple(r) for r in topk.top_k(table, table.where("id = 0"), k=5).collect()] == [(0, 1, 7, 512 * 1024)]
    none = topk.whole_vectors(stored(spark, []), "vec_id", "embedding", 1024)
    assert topk.top_k(none, none).count() == 0


def brute_links(rows, threshold):
    n, links = len(rows), {}
    for a in range(n):
        for b in range(a + 1, n):
            (i, v), (j, w) = rows[a], rows[b]
            if i is None or j is None or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            p, q = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in w))
            if p and q and sum(x * y for x, y in zip(v, w)) / (p * q) >= threshold:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(rows[b][0] for b in seen) if i is not None else None
        out.append((i, len(links.get(a, ())), least, i is None or i == least))
    return out


def test_embedding_links_are_exact(spark):
    rows = exact(spark, vectors())
    got = embedding_dedup.near_duplicates(stored(spark, vectors()), threshold=0.9, block_rows=32)
    key = str
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_links(rows, 0.9), key=key)
    assert embedding_dedup.near_duplicates(stored(spark, [])).count() == 0


def test_long_vectors_take_part_or_are_an_error(spark):
    rows = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, -1.0]), (2, [-3e6, 0.5]), (3, [float("inf"), 0.0])],
                                 "id int, v array<double>")
    found = topk.top_k(topk.whole_vectors(rows, "id", "v", 1), topk.whole_vectors(rows, "id", "v", 1).where("id = 0"))
    assert [(r.id, r.score) for r in found.orderBy("rank").collect()] == [(1, 6 * 10**12 - 1), (2, -9 * 10**12)]
    with pytest.raises(SparkRuntimeException, match="too long for 64-bit products: id 7"):
        topk.whole_vectors(spark.createDataFrame([(7, [3e9, 1.0])], "id int, v array<double>"), "id", "v", 1024).collect()
