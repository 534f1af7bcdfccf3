import re

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from inkprint.functions import arrays, calendar, sampling, text, vectors

CASES = ["", "   ", "12345", "abc", "abcd efg", "日本語のテキスト", "😀😀😀", "abc1", "ab1", "a b\nc d ", "x y z\t\n", "Éa"]


def python_keep(s):
    return len(s) >= 1 and sum(c.isalpha() for c in s) / len(s) >= 0.75


def test_keep_post(spark):
    rows = spark.createDataFrame([(c,) for c in CASES] + [(None,)], "t string")
    got = {r.t: r.k for r in rows.select("t", text.keep_post(F.col("t")).alias("k")).collect()}
    assert got == {**{c: python_keep(c) for c in CASES}, None: False}


def test_words_and_strip(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "t string")
    for r in rows.select("t", text.words(F.col("t")).alias("w"), text.word_count(F.col("t")).alias("n"),
                         text.strip_trailing(F.col("t")).alias("s"), text.clean_newlines(F.col("t")).alias("c"),
                         text.word_tokens(F.col("t")).alias("k")).collect():
        assert r.w == r.t.split()
        assert r.n == len(r.t.split())
        assert r.s == r.t.rstrip()
        assert r.c == r.t.replace("\n", " ")
        assert r.k == re.findall(r"(?u)\b\w\w+\b", r.t)


def test_calendar_is_utc_whatever_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([(1704067207,)], "t bigint").select(
            calendar.hour_of(F.col("t")), calendar.minute_of(F.col("t")), calendar.weekday_of(F.col("t"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == (0, 0, 0)  # Monday, 2024-01-01 00:00:07


def test_unflatten_and_pad(spark):
    rows = spark.createDataFrame(
        [([1, 2, 3, 4], [2, 0, 2]), ([], [0]), ([5], [1])], "v array<int>, n array<int>")
    got = rows.select(arrays.unflatten(F.col("v"), F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == [[[1, 2], [], [3, 4]], [[]], [[5]]]
    padded = rows.select(arrays.pad_rows(arrays.unflatten(F.col("v"), F.col("n")), 3).alias("r")).first().r
    assert padded == [[1, 2, 0], [0, 0, 0], [3, 4, 0]]
    with pytest.raises(SparkRuntimeException, match="more than 3 values"):
        rows.select(arrays.pad_row(F.col("v"), 3).alias("r")).first()


def test_gather_slice_mask_one_hot(spark):
    row = spark.createDataFrame([([10, 20, 30], [2, 0], 2)], "v array<int>, i array<int>, n int").select(
        arrays.gather(F.col("v"), F.col("i")).alias("g"), arrays.slice_at(F.col("v"), F.lit(1), F.lit(2)).alias("s"),
        arrays.sequence_mask(F.col("n"), 4).alias("m"), arrays.one_hot(F.col("n"), 3).alias("o"),
        arrays.one_hot(F.lit(9), 3).alias("z")).first()
    assert (row.g, row.s, row.m, row.o, row.z) == ([30, 10], [20, 30], [True, True, False, False], [0, 0, 1], [0, 0, 0])


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0 + 1e-15, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        vectors.angular_score(F.col("a"), F.col("b")).alias("angular"), vectors.cosine_distance(F.col("a"), F.col("z")).alias("zero"),
        vectors.l2_normalize(F.col("z")).alias("unit")).first()
    assert row.angular == 1.0  # the dot product above 1 is clipped
    assert row.zero == 1.0 and row.unit == [0.0, 0.0]


def test_unknown_metric_is_refused():
    try:
        vectors.metric_distance("hamming", F.lit(1), F.lit(1))
    except ValueError as error:
        assert "hamming" in str(error)
    else:
        raise AssertionError("expected an error")


def test_distinct_positions(spark):
    rows = spark.range(200).select(F.col("id").alias("a"), (F.col("id") % 20).alias("n"))
    got = rows.select("a", "n", sampling.distinct_positions("s", F.col("n"), F.lit(8).cast("bigint"), F.col("a")).alias("p")).collect()
    for r in got:
        assert len(r.p) == min(8, r.n) and r.p == sorted(set(r.p)) and all(0 <= x < r.n for x in r.p)


def test_distinct_positions_are_even(spark):
    got = spark.range(4000).select(F.explode(sampling.distinct_positions(
        "even", F.lit(5).cast("bigint"), F.lit(2).cast("bigint"), F.col("id"))).alias("p")).groupBy("p").count().collect()
    assert all(abs(r["count"] - 1600) < 200 for r in got) and len(got) == 5


def test_episode_length_bounds(spark):
    got = [r.n for r in spark.range(3000).select(sampling.episode_length("s", 1, 16, F.col("id")).alias("n")).collect()]
    assert min(got) >= 1 and max(got) == 16
    assert abs(sum(got) / len(got) - (1 + 15 * 0.75 + 0.5)) < 0.3  # Beta(3, 1) has mean 3/4, rounded up
