import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.functions.sampling import hash32
from inkprint.operators.prefix import (
    nth_smallest, number_rows, running_sums, take_first, take_in_order, with_quantile_bucket, with_range_bucket)


def test_running_sums_with_a_hot_value(spark):
    """Half of all rows share one score; range buckets over (score, id) still split them."""
    rng = np.random.default_rng(1)
    scores = np.where(rng.random(2000) < 0.5, 7.0, rng.integers(0, 20, 2000).astype(float))
    rows = spark.createDataFrame([(int(i), float(s), int(i % 3 == 0)) for i, s in enumerate(scores)], "id bigint, score double, p int")
    placed = with_range_bucket(rows, ["score", "id"], 8)
    assert placed.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 800
    got = {r.id: r.c for r in running_sums(placed, [F.col("score"), F.col("id")], {"c": F.col("p")}).collect()}
    order = np.lexsort((np.arange(2000), scores))
    want = np.cumsum((order % 3 == 0).astype(int))
    assert [got[int(i)] for i in order] == want.tolist()


def test_quantile_buckets_do_not_change_the_answer(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("score"))
    answers = set()
    for buckets in (1, 4, 50):
        placed = with_quantile_bucket(rows, "score", buckets)
        got = running_sums(placed, [F.col("score")], {"n": F.lit(1)}).select("score", "n").collect()
        answers.add(tuple(sorted((r.score, r.n) for r in got)))
    assert len(answers) == 1 and all(n == score + 1 for score, n in answers.pop())


def test_number_rows(spark):
    rows = spark.range(1000).repartition(7)
    got = number_rows(rows, hash32("x", F.col("id")), ["id"], "n", total="t").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and all(r.t == 1000 for r in got)
    again = number_rows(spark.range(1000).repartition(3), hash32("x", F.col("id")), ["id"], "n").orderBy("n").collect()
    assert [r.id for r in got] == [r.id for r in again]


def test_number_rows_per_key(spark):
    rows = spark.range(300).withColumn("k", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 5))
    got = number_rows(rows, hash32("x", F.col("id")), ["id"], "n", keys=["k"]).groupBy("k").agg(
        F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("d"), F.count("*").alias("c")).collect()
    assert all(r.a == 0 and r.b == r.c - 1 and r.d == r.c for r in got)


def test_both_ways_of_taking_agree(spark):
    rows = spark.range(2000)
    small = {r.id for r in take_in_order(rows, hash32("s", F.col("id")), ["id"], 300).collect()}
    large = {r.id for r in take_in_order(rows, hash32("s", F.col("id")), ["id"], 300, small=10).collect()}
    assert small == large and len(small) == 300
    assert {r.id for r in take_first(rows, "id", 450, small=10).collect()} == set(range(450))
    assert take_first(rows, "id", 5000, small=10).count() == 2000


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "timestamp"])
def test_nth_smallest(spark, kind):
    """Ranks within one histogram bucket, ties, shared beginnings and extremes, against a sorted list."""
    rng = np.random.default_rng(2)
    numbers = [int(x) for x in np.r_[rng.integers(0, 30_000, 400), rng.integers(20_000, 20_010, 400)]]
    column = {"bigint": F.col("n") * (1 << 48) - (1 << 62), "double": F.when(F.col("n") > 29_000, F.lit(float("inf"))).otherwise(
        F.exp(F.col("n") / 50.0)), "string": F.concat(F.lit("straße/"), F.col("n").cast("string")),
        "date": F.date_add(F.lit("1500-01-01").cast("date"), F.col("n").cast("int")),
        "timestamp": F.timestamp_seconds("n")}[kind]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(column.alias("k"))
    values = [r.k for r in rows.orderBy("k").collect()]
    for n in (395, 800):
        assert nth_smallest(rows, "k", n, small=20) == values[n - 1]
    assert nth_smallest(rows, "k", 801) is None and nth_smallest(rows, "k", 0) is None
    assert take_first(rows, "k", 500, small=50).count() == 500


def test_take_first_with_missing_keys_and_ties(spark):
    rows = spark.createDataFrame([(None,)] * 3 + [(1,)] * 4 + [(2,)] * 4, "k bigint")
    for count in (2, 3, 5, 7, 9, 20):
        found = [r.k for r in take_first(rows, "k", count, small=1).collect()]
        assert sorted(found, key=lambda k: (k is not None, k or 0)) == ([None] * 3 + [1] * 4 + [2] * 4)[:count]
    assert take_first(rows.limit(0), "k", 5).count() == 0
    plan = take_first(spark.range(1000), "id", 100, small=10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan
