"""Compare every query vector with every target vector without ever forming the pairs as rows.

Both sides are hashed into blocks of bounded size. A query block and a target block meet in one cell of a
grid and are scored there tile by tile, one matrix product per tile. A reducer turns each tile into something small:
rank counts, score counts, the k nearest, or per-query statistics. Rows go to blocks by row id, never by label, so a
label that holds a third of all rows is spread like any other. A task holds two blocks and one tile of scores; the
shuffle moves each query once per target block and each target once per query block. Blocks are cut by the size of
their vectors in bytes: short vectors share large blocks and are copied seldom, long ones never exceed the memory.

Scores are put on a decimal grid. It makes equal vectors tie exactly wherever they are compared, and bounds
the number of distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 16 << 20  # vectors of one block
MAX_PARTITIONS = 20_000
TILE_ROWS = 1024  # a matrix of scores has 8 MB; several are open at a time, in every worker of an executor
DENSE_TERMS = 1024  # shared terms that are multiplied as one dense product
DENSE_GAIN = 400  # so many products of a matrix take the time of one product of single entries
EXPANDED = 1 << 22  # products of single entries at a time
SCORE_DECIMALS = 7
DISTANCE_DECIMALS = 12

SIMILARITIES = ("linear", "angular")
DISTANCES = ("cosine", "euclidean", "manhattan", "chebyshev")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


class _Sparse:
    """The entries of a tile in order of term: rows and weights, and where each distinct term begins."""

    def __init__(self, table: pa.Table) -> None:
        terms = table.column("terms").combine_chunks()
        lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = terms.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.height = table.num_rows
        self.rows = np.repeat(np.arange(len(terms), dtype=np.int32), lengths)[order]
        self.weights = weights[order]
        self.terms, self.starts, self.counts = np.unique(ids[order], return_index=True, return_counts=True)

    def dense(self, at: np.ndarray) -> np.ndarray:
        """The columns of the terms at these places."""
        out = np.zeros((self.height, len(at)))
        column = np.repeat(np.arange(len(at)), self.counts[at])
        entry = np.arange(len(column)) + np.repeat(self.starts[at] - np.r_[0, np.cumsum(self.counts[at])[:-1]], self.counts[at])
        np.add.at(out, (self.rows[entry], column), self.weights[entry])
        return out


def sparse_dot(a: _Sparse, b: _Sparse) -> np.ndarray:
    """Dot products of all rows, term by term: terms that fill much of the product go through dense slices of
    DENSE_TERMS columns, each other term gives one product per entry on either side. Memory follows the entries and the
    tile of scores, whatever the vocabulary."""
    out = np.zeros((a.height, b.height))
    _, left, right = np.intersect1d(a.terms, b.terms, assume_unique=True, return_indices=True)
    products = a.counts[left] * b.counts[right]
    often = products * DENSE_GAIN > out.size
    x, y = left[often], right[often]
    for i in range(0, len(x), DENSE_TERMS):
        out += a.dense(x[i:i + DENSE_TERMS]) @ b.dense(y[i:i + DENSE_TERMS]).T
    x, y, products = left[~often], right[~often], products[~often]
    wave = (np.cumsum(products) - products) // EXPANDED
    cuts = np.r_[0, np.flatnonzero(wave[1:] != wave[:-1]) + 1, len(wave)] if len(wave) else np.zeros(1, int)
    for i, j in zip(cuts[:-1], cuts[1:]):
        n = products[i:j]
        term = np.repeat(np.arange(i, j), n)
        place = np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)
        width = b.counts[y[term]]
        e, f = a.starts[x[term]] + place // width, b.starts[y[term]] + place % width
        cells = a.rows[e].astype(np.int64) * b.height + b.rows[f]
        np.add.at(out.reshape(-1), cells, a.weights[e] * b.weights[f])
    return out


def _score(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer for `linear` and `angular`; the other metrics are distances."""
    if metric == "linear":
        return q @ t.T
    if metric == "angular":
        return 1.0 - np.arccos(np.clip(q @ t.T, -1.0, 1.0)) / math.pi
    if metric == "cosine":
        sizes = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(t, axis=1))
        return 1.0 - np.divide(q @ t.T, sizes, out=np.zeros_like(sizes), where=sizes > 0)
    out = np.empty((len(q), len(t)))
    for j in range(len(t)):
        gap = np.abs(q - t[j])
        if metric == "euclidean":
            out[:, j] = np.sqrt((gap * gap).sum(axis=1))
        elif metric == "manhattan":
            out[:, j] = gap.sum(axis=1)
        elif metric == "chebyshev":
            out[:, j] = gap.max(axis=1)
        else:
            raise ValueError(f"unsupported metric {metric!r}")
    return out


def _blocks(rows: int, other: int, block_rows: int, tasks: int) -> tuple[int, int]:
    """Blocks per side: none above `block_rows`, and enough cells to keep every core busy."""
    left, right = max(1, math.ceil(rows / block_rows)), max(1, math.ceil(other / block_rows))
    while left * right < tasks and max(rows / left, other / right) > 64:
        if rows / left >= other / right:
            left *= 2
        else:
            right *= 2
    return left, right


def grid(queries: DataFrame, targets: DataFrame, block_rows: int | None,
         block_bytes: int = BLOCK_BYTES) -> tuple[int, int, int]:
    """Blocks per side and partitions for their cells. Without `block_rows` a block has `block_bytes` of vectors."""
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    column, width = ("terms", 12) if "terms" in queries.columns else ("vec", 8)
    (left, a), (right, b) = (s.agg(F.count("*"), F.sum(F.size(column).cast("bigint"))).first() for s in (queries, targets))
    per_row = max(a / left if left and a else 1, b / right if right and b else 1, 1) * width
    n_left, n_right = _blocks(left, right, block_rows or max(1, int(block_bytes / per_row)), tasks)
    return n_left, n_right, tasks


class _PerQuery:
    """One row per query and cell. `reduce` makes columns with a value per query of a tile; `merge` says how those of
    the next tile are added. A cell goes through its tiles query rows first, so one strip of queries is open."""

    def __init__(self, reduce: Callable, merge: dict[str, Callable], schema: pa.Schema) -> None:
        self.reduce, self.merge, self.schema = reduce, merge, schema
        self.strip, self.open, self.parts = None, None, []

    def _close(self) -> None:
        if self.open is not None:
            self.parts.append(pa.table(self.open).select(self.schema.names).cast(self.schema))

    def add(self, q: pa.Table, t: pa.Table, scores: np.ndarray) -> None:
        if q is not self.strip:
            self._close()
            self.strip, self.open = q, None
        if not scores.size:
            return
        found = self.reduce(q, t, scores)
        if self.open is not None:
            found.update({c: f(self.open[c], found[c]) for c, f in self.merge.items()})
        self.open = found

    def result(self) -> pa.Table:
        self._close()
        return pa.concat_tables(self.parts) if self.parts else self.schema.empty_table()


def per_query(reduce: Callable, merge: dict[str, Callable], **types: pa.DataType) -> Callable[[], _PerQuery]:
    return lambda: _PerQuery(reduce, merge, pa.schema(types))


class _Counts:
    """Counts scores of a whole cell on the decimal grid. Counters come in pages of neighbouring grid points, so the
    memory follows the range of scores that occur, not the number of pairs. Tiles with few pairs, and tiles whose scores
    are too far apart for pages, are sorted and counted instead; their tables are merged as they grow."""

    PAGE = 1 << 22
    MAX_PAGES = 8
    MERGE_ROWS = 1 << 21

    def __init__(self, sign: float, decimals: int) -> None:
        self.sign, self.scale = sign, 10.0 ** decimals
        self.pages: dict[int, np.ndarray] = {}
        self.sorted: list[np.ndarray] = []  # rows: point, pos, neg
        self.limit = self.MERGE_ROWS

    def _keep(self, points: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        self.sorted.append(np.stack([points, pos.astype(np.int64), neg.astype(np.int64)]))
        if sum(x.shape[1] for x in self.sorted) > self.limit:
            self._merge()
            self.limit = max(self.MERGE_ROWS, 2 * self.sorted[0].shape[1])

    def _merge(self) -> None:
        every = np.concatenate(self.sorted, axis=1)
        order = np.argsort(every[0], kind="stable")
        every = every[:, order]
        starts = np.flatnonzero(np.r_[True, every[0, 1:] != every[0, :-1]])
        self.sorted = [np.stack([every[0, starts], *np.add.reduceat(every[1:], starts, axis=1)])]

    def _table(self, points: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> pa.Table:
        return pa.table({"score": points / self.scale + 0.0, "pos": pos.astype(np.int64), "neg": neg.astype(np.int64)})

    def add(self, q: pa.Table, t: pa.Table, scores: np.ndarray) -> None:
        same = (_numbers(q, "label")[:, None] == _numbers(t, "label")[None, :]).ravel()
        points = np.rint(self.sign * scores.ravel() * self.scale).astype(np.int64)
        page = points // self.PAGE
        numbers = np.unique(page)
        if not len(points):
            return
        if 8 * len(points) < self.PAGE or len(self.pages.keys() | set(numbers.tolist())) > self.MAX_PAGES:
            values, at = np.unique(points, return_inverse=True)
            self._keep(values, np.bincount(at[same], minlength=len(values)), np.bincount(at[~same], minlength=len(values)))
            return
        for number in numbers.tolist():
            here = page == number
            # Even slots count other-author pairs, odd slots same-author pairs.
            slots = (points[here] - number * self.PAGE) * 2 + same[here]
            counts = np.bincount(slots, minlength=2 * self.PAGE)
            if number in self.pages:
                self.pages[number] += counts
            else:
                self.pages[number] = counts

    def result(self) -> pa.Table:
        if self.sorted:
            self._merge()
        parts = [self._table(*x) for x in self.sorted]
        for number, counts in self.pages.items():
            pairs = counts.reshape(-1, 2)
            used = np.flatnonzero(pairs.any(axis=1))
            parts.append(self._table(used + number * self.PAGE, pairs[used, 1], pairs[used, 0]))
        empty = np.array([], np.int64)
        return pa.concat_tables(parts) if parts else self._table(empty, empty, empty)


class _Nearest:
    """The k nearest targets of every query row of a cell. A cell goes through its tiles query rows first, so only the
    state of one strip of queries is open; rows are kept by their place in the strip, as ids may repeat."""

    def __init__(self, k: int, sign: float) -> None:
        self.k, self.sign = k, sign
        self.strip, self.open = None, None  # row, distance, target id, target label
        self.parts: list[pa.Table] = []

    def _best(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, distance, row))
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[kept], *(x[order][kept] for x in (distance, ids, labels))

    def _close(self) -> None:
        if self.open is not None:
            row, distance, ids, labels = self.open
            self.parts.append(pa.table({
                "q": _numbers(self.strip, "id")[row], "t": ids, "distance": distance, "t_label": labels,
                "q_label": _numbers(self.strip, "label")[row]}))

    def add(self, q: pa.Table, t: pa.Table, scores: np.ndarray) -> None:
        if q is not self.strip:
            self._close()
            self.strip, self.open = q, None
        d = self.sign * scores + 0.0
        if not d.size:
            return
        # Everything up to the k-th distance, ties included; the ties are then settled by id.
        keep = min(self.k, d.shape[1])
        last = np.partition(d, keep - 1, axis=1)[:, keep - 1:keep]
        row, column = np.nonzero(d <= last)
        found = (row, d[row, column], _numbers(t, "id")[column], _numbers(t, "label")[column])
        if self.open is not None:
            found = tuple(np.concatenate(x) for x in zip(self.open, found))
        self.open = self._best(*found)

    def result(self) -> pa.Table:
        self._close()
        if self.parts:
            return pa.concat_tables(self.parts)
        whole = ("q", "t", "distance", "t_label", "q_label")
        return pa.table({c: pa.array([], pa.float64() if c == "distance" else pa.int64()) for c in whole})


def pair_cells(
    queries: DataFrame,
    targets: DataFrame,
    reducer: Callable,
    schema: str,
    metric: str = "cosine",
    decimals: int | None = DISTANCE_DECIMALS,
    block_rows: int | None = None,
) -> DataFrame:
    """Score every tile of every cell of the grid. `reducer()` makes an accumulator for a cell: its `add(query tile,
    target tile, score matrix)` sees all tiles, those of one strip of queries in a row, and `result()` answers once.

    Both sides need `id`, `label` and either `vec` or the sparse pair (`terms`, `weights`); other columns
    travel along for the reducer.
    """
    if metric not in SIMILARITIES + DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; choose one of {SIMILARITIES + DISTANCES}")
    sparse = "terms" in queries.columns
    if sparse and metric != "linear":
        raise ValueError("sparse vectors support the linear metric only")
    n_left, n_right, tasks = grid(queries, targets, block_rows)

    left = queries.withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = targets.withColumn("_j", F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    # Both sides may stem from one table; renaming gives each its own attributes. One partitioning serves the
    # cogroup: one cell a partition as far as a stage can have that many tasks, so that no task sorts many cells.
    partitions = min(n_left * n_right, max(4 * tasks, MAX_PARTITIONS))
    left = left.toDF(*left.columns).repartition(partitions, "_i", "_j")
    right = right.toDF(*right.columns).repartition(partitions, "_i", "_j")

    def vectors(tile: pa.Table) -> _Sparse | np.ndarray:
        return _Sparse(tile) if sparse else _matrix(tile, "vec")

    def score_tile(a: _Sparse | np.ndarray, b: _Sparse | np.ndarray) -> np.ndarray:
        scores = sparse_dot(a, b) if sparse else _score(a, b, metric)
        return scores if decimals is None else np.round(scores, decimals) + 0.0

    def cell(q: pa.Table, t: pa.Table) -> pa.Table:
        found = reducer()
        if q.num_rows and t.num_rows:
            others = [t.slice(j, TILE_ROWS) for j in range(0, t.num_rows, TILE_ROWS)]
            others = [(b, vectors(b)) for b in others]
            for i in range(0, q.num_rows, TILE_ROWS):
                strip = q.slice(i, TILE_ROWS)
                a = vectors(strip)
                for b, made in others:
                    found.add(strip, b, score_tile(a, made))
        return found.result()

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(cell, schema)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def score_statistics(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
                     decimals: int | None = SCORE_DECIMALS, block_rows: int | None = None) -> DataFrame:
    """Per query over all targets: how many, how many of the same author, and score sum, least and greatest."""

    def reduce(q, t, s):
        same = _numbers(q, "label")[:, None] == _numbers(t, "label")[None, :]
        return {"q": _numbers(q, "id"), "n": np.full(len(s), s.shape[1], np.int64), "m": same.sum(axis=1),
                "total": s.sum(axis=1), "least": s.min(axis=1), "greatest": s.max(axis=1)}

    merge = {"n": np.add, "m": np.add, "total": np.add, "least": np.minimum, "greatest": np.maximum}
    whole, real = pa.int64(), pa.float64()
    cells = pair_cells(queries, targets, per_query(reduce, merge, q=whole, n=whole, m=whole, total=real, least=real, greatest=real),
                       "q bigint, n bigint, m bigint, total double, least double, greatest double",
                       metric, decimals, block_rows)
    return cells.groupBy("q").agg(
        F.sum("n").alias("n_targets"), F.sum("m").alias("n_same_author"), F.sum("total").alias("score_sum"),
        F.min("least").alias("score_min"), F.max("greatest").alias("score_max"))


def score_distribution(queries: DataFrame, targets: DataFrame, metric: str = "cosine",
                       decimals: int = SCORE_DECIMALS, block_rows: int | None = None) -> DataFrame:
    """(score, pos, neg): how many same-author and other-author pairs have each score. Distances are negated, so
    larger always means closer. The size is bounded by the score grid, not by the number of pairs; a cell
    counts all its pairs before it hands on at most one row per grid point."""
    sign = 1.0 if metric in SIMILARITIES else -1.0
    cells = pair_cells(queries, targets, lambda: _Counts(sign, decimals), "score double, pos bigint, neg bigint",
                       metric, decimals, block_rows)
    return cells.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def nearest_targets(queries: DataFrame, targets: DataFrame, k: int, metric: str = "cosine",
                    decimals: int = DISTANCE_DECIMALS, block_rows: int | None = None) -> DataFrame:
    """The k nearest targets of each query by (distance, target id). A cell keeps the best of its tiles so far and hands
    on at most k rows per query."""
    from pyspark.sql import Window

    sign = -1.0 if metric in SIMILARITIES else 1.0
    cells = pair_cells(queries, targets, lambda: _Nearest(k, sign),
                       "q bigint, t bigint, distance double, t_label bigint, q_label bigint",
                       metric, decimals, block_rows)
    best = Window.partitionBy("q").orderBy("distance", "t")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
