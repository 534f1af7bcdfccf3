"""Running totals and row numbers without a global sort in one task.

A window without partition keys moves the whole table to one task. Here every row first gets an
order-preserving bucket. Per-bucket totals are small (one row per bucket), their running total gives each
bucket its offset, and the window only runs inside buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.functions.sampling import HASH_RANGE
from inkprint.session import settle

DEFAULT_BUCKETS = 4096


def buckets_for(rows: int, rows_per_bucket: int = 250_000, least: int = 64, most: int = 1 << 20) -> int:
    """As many buckets as the rows need, so that a bucket keeps its size when the data grow."""
    return max(least, min(most, rows // rows_per_bucket + 1))


def hash_bucket(hashed: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    """Order-preserving bucket of a 32-bit hash: no sampling and no skew on distinct keys."""
    return F.floor(hashed / F.lit(HASH_RANGE // buckets)).cast("int")


def with_quantile_bucket(df: DataFrame, column: str, buckets: int, name: str = "_bucket") -> DataFrame:
    """Order-preserving bucket of a numeric column between literal quantile bounds.

    The bounds are constants of the plan, so every pass puts a row into the same bucket, and any choice of
    bounds gives the same answer. All rows with one value share a bucket: use it on distinct values.
    """
    grid = [i / buckets for i in range(1, buckets)]
    bounds = df.approxQuantile(column, grid, 1.0 / (4 * buckets)) if grid else []
    inner = sorted(set(bounds))
    if not inner:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_cut", outputCol=name, handleInvalid="error")
    return cut.transform(df.withColumn("_cut", F.col(column).cast("double"))).drop("_cut").withColumn(
        name, F.col(name).cast("int"))


def with_range_bucket(df: DataFrame, order: Sequence[str], buckets: int, name: str = "_bucket") -> DataFrame:
    """Order-preserving bucket over several columns, balanced even when the first one is heavily tied.

    Range bounds are sampled anew on every run, so the bucket is written once with the rows.
    """
    ranged = df.repartitionByRange(buckets, *order).withColumn(name, F.spark_partition_id())
    return settle(ranged)


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    bucket: str = "_bucket",
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running totals along (bucket, order), separately for every combination of `keys`.

    `bucket` must not decrease along `order`. With `totals`, also add `<name>_total` per key combination.
    """
    keys = list(keys)
    measured = df
    for name, value in sums.items():
        measured = measured.withColumn(f"_m_{name}", value.cast("bigint"))
    per_bucket = measured.groupBy(*keys, bucket).agg(
        *[F.sum(f"_m_{name}").alias(f"_s_{name}") for name in sums])
    # One row per bucket (and key): the only window not split by bucket.
    outer = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = outer.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.sum(f"_s_{n}").over(outer).alias(f"{n}_total") for n in sums] if totals else []),
    )
    joined = measured.join(offsets if keys else F.broadcast(offsets), [*keys, bucket])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_m_{n}").over(inside)).alias(n) for n in sums],
        *([F.col(f"{n}_total") for n in sums] if totals else []),
    )


def number_rows(
    df: DataFrame, hashed: Column, tie: Sequence[str], name: str, keys: Sequence[str] = (),
    buckets: int | None = None, total: str | None = None,
) -> DataFrame:
    """Consecutive numbers from 0 in the order of a 32-bit hash, ties by the `tie` columns; per key if given.
    `total` names a column for the number of rows (per key). Without `buckets` the rows are counted first."""
    buckets = buckets or buckets_for(df.count())
    hashed_rows = df.withColumn("_hash", hashed).withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    numbered = running_sums(hashed_rows, [F.col("_hash"), *[F.col(t) for t in tie]], {name: F.lit(1)}, keys,
                            totals=total is not None)
    numbered = numbered.withColumn(name, F.col(name) - 1).drop("_hash", "_bucket")
    return numbered.withColumnRenamed(f"{name}_total", total) if total else numbered


def take_in_order(
    df: DataFrame, hashed: Column, tie: Sequence[str], count: int, small: int = 100_000,
) -> DataFrame:
    """First `count` rows in hash order. Small counts use the built-in top-n; large ones are numbered in buckets,
    because a top-n gathers all its rows in one task."""
    if count <= small:
        hashed_rows = df.withColumn("_hash", hashed)
        return hashed_rows.orderBy("_hash", *tie).limit(count).drop("_hash")
    return number_rows(df, hashed, tie, "_number").where(F.col("_number") < count).drop("_number")


SELECT_BUCKETS = 4096


def _place(key: Column, kind: str, skip: int) -> Column:
    """A number that does not decrease along the key. Text counts by its bytes after the first `skip`."""
    if kind in ("string", "binary"):
        head = F.rpad(F.substring(F.encode(key, "utf-8") if kind == "string" else key, skip + 1, 6), 6, bytes(1))
        return F.conv(F.hex(head), 16, 10).cast("double")
    number = F.unix_date(key) if kind == "date" else key
    largest = 4e307  # the difference of two places stays finite; not-a-number is the greatest value
    return F.greatest(F.lit(-largest), F.least(F.lit(largest), number.cast("double") / 4))


def nth_smallest(df: DataFrame, key: str, n: int, small: int = 100_000):
    """The n-th smallest key that is not null, or None if there are fewer: histogram after histogram, each narrowed to the
    bucket that holds rank n, until that bucket has at most `small` rows. Exact, for numbers, dates and text; the driver
    sees SELECT_BUCKETS rows a pass, and a pass shuffles no more than that from each task."""
    kind = df.schema[key].dataType.simpleString()
    part, column = df.select(key).where(F.col(key).isNotNull()), F.col(key)
    rows, low, high = part.agg(F.count("*"), F.min(key), F.max(key)).first()
    if not 0 < n <= rows:
        return None
    while rows > small:
        skip = 0
        if kind in ("string", "binary"):
            a, b = (x.encode() if isinstance(x, str) else bytes(x) for x in (low, high))
            skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        place = _place(column, kind, skip)
        first, last = (_place(F.lit(x).cast(kind), kind, skip) for x in (low, high))
        cut = F.least(F.lit(SELECT_BUCKETS - 1), F.floor((place - first) / F.nullif(last - first, F.lit(0.0)) * SELECT_BUCKETS))
        found = part.where(column.between(F.lit(low).cast(kind), F.lit(high).cast(kind))).groupBy(cut.alias("b")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("b").collect()
        for bucket in found:
            if n <= bucket["n"]:
                break
            n -= bucket["n"]
        if len(found) == 1:
            break  # one value, or values that no number tells apart
        rows, low, high = bucket["n"], bucket["low"], bucket["high"]
    if low == high:
        return low
    last = part.where(column.between(F.lit(low).cast(kind), F.lit(high).cast(kind))).orderBy(key).limit(n)
    return last.agg(F.max(key)).first()[0]


def take_first(df: DataFrame, key: str, count: int, small: int = 100_000) -> DataFrame:
    """First `count` rows by key, rows without one first. The result is a filter on the key, which reaches the scan: no row
    is moved. Of rows that tie at the last place, any will do; a unique key leaves no choice."""
    column = F.col(key)
    missing = df.where(column.isNull()).limit(count).count()
    last = nth_smallest(df, key, count - missing, small) if missing < count else None
    if missing == count:
        return df.where(column.isNull()).limit(count)
    if last is None:
        return df
    bound = F.lit(last).cast(df.schema[key].dataType)
    below, tied = df.agg(F.count_if(column < bound), F.count_if(column == bound)).first()
    if missing + below + tied == count:
        return df.where(column.isNull() | (column <= bound)) if missing else df.where(column <= bound)
    return df.where(column.isNull() | (column < bound)).unionByName(
        df.where(column == bound).limit(count - missing - below))
