"""Helpers shared by the operators: rows, hashes of byte windows, groups of linked ids."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkprint.session import settle

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def power(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return power(BASE), power(INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _prefix(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(len(part)).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=total[1:])
    return total, inverse


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of `width` bytes, by prefix sums of a polynomial, in blocks of bounded size."""
    n = len(data) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        total, inverse = _prefix(data[at:end + width - 1])
        out[at:end] = mix((total[width:] - total[:-width]) * inverse[:end - at])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit hash of the bytes of each span; both ends must ascend."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), step):
        a, b = starts[at:at + step], ends[at:at + step]
        total, inverse = _prefix(data[a[0]:b[-1]])
        h = (total[b - a[0]] - total[a - a[0]]) * inverse[a - a[0]]
        out[at:at + step] = mix(h + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def list_column(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Equally long lists without nulls as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def root_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; every set is named by its smallest member."""
    while True:
        parent = root_of(parent)
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def components(links: DataFrame, a: str = "a", b: str = "b", small: bool = False) -> DataFrame:
    """(node, component) of all ids in undirected links; the component is the smallest id reachable.

    Alternates large-star and small-star steps: every node points its larger neighbours, then its smaller ones, to
    the least id it knows. Each round is written to the shared folder; the links shrink to one per node. `small` says
    that the links were counted and are few: they stay in one partition and are not dealt out in every round.
    """
    held = lambda df: df.coalesce(1) if small else df
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo")
    edges = held(settle(held(edges).distinct()))
    while True:
        both = held(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = held(settle(held(
            large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
            .unionByName(down.select("hi", F.col("m").alias("lo")))).distinct()))
        roles = held(edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))))
        open_ = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where(
            "up > 1 or (up = 1 and root = 1)")
        if open_.isEmpty():
            break
    pairs = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return pairs.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
