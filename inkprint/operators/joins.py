"""Lookup joins that stand hot keys on the fact side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20  # as JSON text, which is longer than the rows in memory
HOT_KEYS = 1000
TRACKED_KEYS = 16_384  # every key with more than about 1 / 4,000 of the rows is among those found
GROUP_ROWS = 250_000


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table is small in rows and in bytes, measured on at most `max_rows` + 1 of its rows."""
    head = df.limit(max_rows + 1)
    rows, size = head.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[head[c] for c in head.columns]))))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def hot_keys(facts: DataFrame, key: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, salts) for the keys whose rows need more than one group of `group_rows`: at most HOT_KEYS rows, from one
    pass with a frequent-items sketch whose partial results merge. A share of 1 / 4,000 of all rows is found for certain;
    what is found decides how rows are spread, never which rows match. On a large table a group is as large as an even
    share of a task's work."""
    tasks = facts.sparkSession.sparkContext.defaultParallelism
    rows, found = facts.agg(
        F.count(key), F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS})")).first()
    group = max(group_rows, math.ceil(rows / (4 * tasks)))
    kind = facts.schema[key].dataType.simpleString()
    hot = [(f["item"], math.ceil(f["count"] / group)) for f in found or [] if f["count"] > group]
    return facts.sparkSession.createDataFrame(hot, f"`{key}` {kind}, _salts int")


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, spread_by: str, how: str = "inner",
                   max_rows: int = MAX_BROADCAST_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Join facts with a table that is unique on `key`.

    A dimension measured to be small is broadcast. Beyond that both sides are shuffled; the rows of a hot key are dealt
    out by a hash of `spread_by` to as many groups as its share calls for, and only the dimension rows of hot keys are
    copied. Facts without a key match nothing and are dealt out too.
    """
    if fits_broadcast(dimension, max_rows):
        return facts.join(F.broadcast(dimension), key, how)
    hot = F.broadcast(hot_keys(facts, key, group_rows))  # at most HOT_KEYS rows
    copies = dimension.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    tasks = facts.sparkSession.sparkContext.defaultParallelism
    groups = F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = facts.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), groups).cast("int"))
    return salted.drop("_salts").join(copies, [key, "_salt"], how).drop("_salt")
