"""Near duplicates among embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.llm.common import components, list_column, unite
from inkprint.session import settle

LEVELS = 127
SLACK = 1e-5  # covers the rounding of 32-bit products and of the bounds themselves


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers in -127..127, the scale of each row, and the exact length of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / LEVELS
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def _tile(threshold: float, rows: int = 512, pairs: int = 1 << 16) -> Callable[[pa.Table], pa.Table]:
    def links(cell: pa.Table) -> pa.Table:
        """One cell: every class of one block against every class of another, or a block against itself."""
        dim, i, j = (cell.column(c)[0].as_py() for c in ("dim", "i", "j"))
        block = cell.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        ids, n = cell.column("class_id").to_numpy()[order], cell.column("n").to_numpy()[order]
        vec = list_column(cell.column("vec"), dim)[order]
        vec /= np.abs(vec).max(axis=1, keepdims=True)  # lengths stay finite
        length = np.linalg.norm(vec, axis=1)
        q, scale, error = quantise(vec / length[:, None])
        first = int((block == i).sum())
        left, right = range(0, first), (0 if i == j else first)
        wide = q[right:].astype(np.float32).T  # products of int8 sums are whole numbers below 2^24: exact
        far = error[right:]
        parent, counted = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for at in range(0, len(left), rows):
            own = np.arange(at, min(at + rows, len(left)))
            product = q[own].astype(np.float32) @ wide if dim * LEVELS * LEVELS < 1 << 24 else (
                q[own].astype(np.float64) @ wide.astype(np.float64))
            bound = product * scale[own, None] * scale[None, right:]
            bound += error[own, None] + (1 + error[own, None]) * far[None, :]
            a, b = np.nonzero(bound >= threshold - SLACK)
            a, b = own[a], b + right
            if i == j:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), pairs):
                x, y = a[k:k + pairs], b[k:k + pairs]
                cosine = np.einsum("ij,ij->i", vec[x], vec[y]) / (length[x] * length[y])
                x, y = x[cosine >= threshold], y[cosine >= threshold]
                np.add.at(counted, x, n[y])
                np.add.at(counted, y, n[x])
                parent = unite(parent, x, y)
        # Sets are named by position; the ids decide later which name is smallest.
        some = np.flatnonzero(counted)
        return pa.table({"class_id": ids[some], "other": ids[parent[some]], "links": counted[some]})

    return links


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block_rows: int = 4096, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept; links are pairs with cosine >= `threshold` (above 0).

    Equal vectors form one class and meet nothing twice. Classes are hashed into blocks; two blocks meet in one cell.
    A cell multiplies int8 rows. If u = s q + r is a unit row with rounding loss |r| = e, a cosine differs from
    s s' q.q' by at most e + (1 + e) e', so pairs below the threshold by more are settled; only the others are computed
    in double precision. A cell hands on counts and a spanning forest, at most two numbers per row, never its pairs.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing;
    vectors of different lengths never link; rows that repeat an id are separate vectors; a null id links with nothing
    and is kept; an empty table gives an empty result; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    x = F.col("vec")
    usable = F.col("id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vec")).withColumn(
        "ok", F.coalesce(usable, F.lit(False)))
    keyed = rows.select("id", "ok", "vec", F.when(F.col("ok"), F.xxhash64("vec")).alias("k1"),
                        F.when(F.col("ok"), F.xxhash64(F.lit(1), "vec")).alias("k2"))
    classes = settle(keyed.where("ok").groupBy("k1", "k2").agg(
        F.min("id").alias("class_id"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    blocks = -(-classes.count() // block_rows) or 1
    placed = classes.select("class_id", "n", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"),
                            F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("block"))
    cells = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "dim", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "class_id", "n", "vec")
    found = settle(cells.groupBy("dim", "i", "j").applyInArrow(
        _tile(threshold), "class_id bigint, other bigint, links bigint"))
    group = components(found, "class_id", "other")
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    of_class = (classes.select("k1", "k2", "class_id", "n").join(counts, "class_id", "left")
                .join(group, F.col("class_id") == F.col("node"), "left")
                .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "class_id").alias("component_id")))
    out = keyed.drop("vec").join(of_class, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
