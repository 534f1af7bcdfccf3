"""Reproducible draws: a hash of (seed, key) instead of a random generator.

The value depends only on the row, so it survives retries and any partitioning, filters can be pushed
below it, and another SQL engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 4294967296  # 2 ** 32


def hash32(seed: str, *keys: Column) -> Column:
    """An unsigned 32-bit integer as bigint."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1)."""
    return hash32(seed, *keys) / F.lit(float(HASH_RANGE))


def episode_length(seed: str, shortest: int, longest: int, *keys: Column) -> Column:
    """Fixed when the bounds agree; otherwise ceil((longest - shortest) * Beta(3, 1)) + shortest, drawn per row
    through the inverse of the Beta(3, 1) distribution function, u ** (1/3)."""
    if shortest == longest:
        return F.lit(longest).cast("bigint")
    beta = F.pow(unit_draw(seed + "/length", *keys), F.lit(1.0 / 3.0))
    return (F.ceil(F.lit(longest - shortest) * beta) + F.lit(shortest)).cast("bigint")


def episode_start(seed: str, count: Column, length: Column, *keys: Column) -> Column:
    """Uniform over [0, count - length]."""
    return hash32(seed + "/start", *keys) % (count - length + 1)


def distinct_positions(seed: str, count: Column, length: Column, *keys: Column) -> Column:
    """`length` different positions out of [0, count), each subset equally likely, in ascending order.

    Floyd's method: for j = count-length .. count-1 draw t in [0, j] and take t, or j when t was taken already.
    The work is per episode and does not touch the posts.
    """
    take = F.least(length, count)
    steps = F.when(take > 0, F.sequence(count - take, count - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, j: Column) -> Column:
        t = hash32(seed + "/pick", *keys, j) % (j + 1)
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(j))).otherwise(F.concat(acc, F.array(t)))

    return F.array_sort(F.aggregate(steps, F.array().cast("array<bigint>"), step))
