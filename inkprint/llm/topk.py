"""Exact top-k search by inner product with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from inkprint.llm.common import list_column
from inkprint.session import settle

PIVOTS = 16
RINGS = 8
CELL_ROWS = 4096
MARGIN = 1e-6  # relative slack of distances computed in double precision


def _key(dim: int, pivots: np.ndarray, far: float) -> Callable:
    """Nearest pivot and distance, in the space where one more coordinate gives all vectors the same length."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.int64())), ("pivot", pa.int32()), ("dist", pa.float64()),
                        ("all", pa.list_(pa.float64()))])

    def key(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = list_column(batch.column("vec"), dim)
            square = np.einsum("ij,ij->i", vec, vec)
            # Stored vectors get the missing length as a coordinate, pivots too; queries get 0 there.
            lift = np.sqrt(np.maximum(far - square, 0))
            dist = np.sqrt(np.maximum(
                ((np.hstack([vec, lift[:, None]])[:, None, :] - pivots[None]) ** 2).sum(2), 0))
            asked = np.sqrt(((np.hstack([vec, np.zeros((len(vec), 1))])[:, None, :] - pivots[None]) ** 2).sum(2))
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(near.astype(np.int32)),
                 pa.array(dist[np.arange(len(vec)), near]), pa.array(list(asked), pa.list_(pa.float64()))], schema=schema)

    return key


def _score(k: int) -> Callable:
    """Best k stored rows of one cell for each query that reached it."""

    def score(queries: pa.Table, stored: pa.Table) -> pa.Table:
        names = ("key", "query_id", "id", "score")
        empty = pa.table({name: pa.array([], pa.int64()) for name in names})
        if not queries.num_rows or not stored.num_rows:
            return empty
        dim = len(queries.column("vec")[0])
        ids, vec = stored.column("id").to_numpy(), list_column(stored.column("vec"), dim, np.int64)
        order = np.argsort(ids, kind="stable")
        ids, vec = ids[order], vec[order]
        keys, asked = queries.column("key").to_numpy(), queries.column("query_id").to_numpy()
        query = list_column(queries.column("vec"), dim, np.int64)
        top = float(np.abs(vec).max(initial=0)) * float(np.abs(query).max(initial=0)) * dim
        kind = np.float64 if top < 2.0 ** 53 else np.int64  # both exact
        wide, out, least = vec.astype(kind).T, [], np.iinfo(np.int64).min
        for at in range(0, len(asked), 256):
            s = (query[at:at + 256].astype(kind) @ wide).astype(np.int64)
            for row, key, q in zip(s, keys[at:at + 256], asked[at:at + 256], strict=True):
                row[ids.searchsorted(q, "left"):ids.searchsorted(q, "right")] = least  # any number of own rows
                keep = np.arange(len(ids))
                if len(ids) > k:
                    keep = np.flatnonzero(row >= np.partition(row, -k)[-k])
                keep = keep[ids[keep] != q]
                keep = keep[np.argsort(-row[keep], kind="stable")][:k]  # ids ascend: ties go to the smaller
                out.append((np.full(len(keep), key), np.full(len(keep), q), ids[keep], row[keep]))
        return pa.table({c: np.concatenate(x) for c, x in zip(names, zip(*out, strict=True), strict=True)})

    return score


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, n_pivots: int = PIVOTS, rings: int = RINGS,
          cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, id, score: the k largest integer inner products of each query with all rows but those of its id.

    `vectors` and `queries` hold (id bigint, vec array<bigint>) without nulls. Inner products become distances by
    giving every stored vector one more coordinate, so that all have the same length R: |q - v|^2 = |q|^2 + R^2 - 2 q.v.
    The index keys a row by its nearest pivot p and its distance r = |p - v|; r is cut into rings of equal width, large
    rings into cells of about `cell_rows`. The pivots are a bounded sample (the `n_pivots` rows that come first in hash
    order); all rows are indexed. A query first scores the ring that its own distance to each pivot falls in; its k-th
    score there bounds the distance d of any better row, and by the triangle inequality such a row of pivot p has
    |r - |p - q|| <= d. Only the rings within the bound follow, and rings beyond are never opened. The result is exact.

    Defined cases: ties go to the smaller id; fewer than k rows give fewer ranks; vectors of other lengths than a query
    are no candidates; rows that repeat an id all count as candidates; equal
    queries give one list, unequal ones of one id a list each; an empty table gives no rows.
    """
    schema = "query_id bigint, rank int, id bigint, score bigint"
    stored = settle(vectors.select("id", "vec", F.size("vec").alias("dim")))
    asked = settle(queries.select("id", "vec", F.size("vec").alias("dim")).distinct())
    dims = [r.dim for r in asked.select("dim").distinct().collect()]  # lengths of vectors, usually one
    spark = vectors.sparkSession
    parts = []
    for dim in sorted(dims):
        mine = stored.where(F.col("dim") == dim)
        square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        far = mine.agg(F.max(square)).first()[0]
        if far is None or dim == 0:
            continue
        sample = np.array([r.vec for r in mine.orderBy(F.xxhash64("vec"), "id").limit(n_pivots).collect()], np.float64)
        lift = np.sqrt(np.maximum(far - (sample ** 2).sum(1), 0))
        pivots = np.hstack([sample, lift[:, None]])
        key = _key(dim, pivots, far)
        fields = "id bigint, vec array<bigint>, pivot int, dist double, all array<double>"
        index = mine.mapInArrow(key, fields).drop("all")
        width = 2.0 * np.sqrt(far) / rings or 1.0  # no distance exceeds twice the length
        index = settle(index.withColumn("ring", F.floor(F.col("dist") / width).cast("int")))
        counts = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"),
                                                    F.max("dist").alias("high"))
        # One row per pivot and ring: at most n_pivots x (rings + 1), whatever the input.
        rings_of = F.broadcast(counts.withColumn("cells", F.ceil(F.col("n") / cell_rows).cast("int")))
        cells = index.join(rings_of.select("pivot", "ring", "cells"), ["pivot", "ring"]).select(
            "pivot", "ring", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"), "id", "vec")
        q_blocks = -(-asked.count() // cell_rows) or 1
        cells = cells.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select(
            F.struct("pivot", "ring", "cell", "q_block").alias("place"), "id", "vec")
        q_block = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q_block")
        q = settle(asked.where(F.col("dim") == dim).mapInArrow(key, fields).select(
            F.xxhash64("id", "vec").alias("key"), F.col("id").alias("query_id"), "vec", F.posexplode("all").alias("pivot", "d")))
        reach = q.join(rings_of, "pivot").withColumn(
            "gap", F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0)))
        spread = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

        def visit(rows: DataFrame) -> DataFrame:
            to = rows.select("pivot", "ring", spread.alias("cell"), q_block, "key", "query_id", "vec").select(
                F.struct("pivot", "ring", "cell", "q_block").alias("place"), "key", "query_id", "vec")
            return to.groupBy("place").cogroup(cells.groupBy("place")).applyInArrow(
                _score(k), "key bigint, query_id bigint, id bigint, score bigint")

        closest = Window.partitionBy("key", "query_id").orderBy("gap", "d", "pivot", "ring")
        order = reach.withColumn("turn", F.row_number().over(closest))
        first = settle(_best(visit(order.where("turn <= 2")), k))
        length = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        kth = first.groupBy("key", "query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        bound = F.sqrt(F.greatest(length + far - 2.0 * F.col("kth"), F.lit(0.0)))
        rest = order.where("turn > 2").join(kth, ["key", "query_id"], "left").where(
            F.col("kth").isNull() | (F.col("gap") <= bound + MARGIN * (1.0 + np.sqrt(far) + F.sqrt(length))))
        parts.append(_best(first.drop("rank").unionByName(visit(rest)), k))
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part.select("query_id", "rank", "id", "score"))
    return out


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale x component). Rows with a null id, a null vector, or a null or non-finite component drop
    out. A vector whose squared length reaches 2^62 is an error, for its inner products might not fit 64 bits; below,
    no sum of products of two vectors leaves them."""
    x = F.col("x")
    ok = F.col("id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * scale * (v * scale))
    wide = F.raise_error(F.concat(F.lit("a vector is too long for 64-bit products: id "), F.col("id").cast("string")))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.coalesce(ok, F.lit(False))).select("id", F.when(square < 2.0 ** 62, whole).otherwise(wide).alias("vec"))
