"""Verification metrics exact to a number of decimals, without listing scores.

The area under the curve needs the order of all scores, but a number of decimals needs less: counts of both classes in
slots of the line of scores bound it from both sides. Every round counts all pairs once more, in finer slots where a
metric is still open, until all decimals are certain: the bounds round alike, and around the equal error rate the scores
themselves are known. Nothing is estimated, and no pair is left out.

What a cell sends on has a bounded size, whatever its pairs and labels: counts of at most 2 SLOTS slots, or the scores of
at most LISTED pairs of all cells together. The driver holds those counts and no rows.

Scores are those of `intervals.exact_closeness`. Slots are stretches of the doubles in their order, so the same numbers
bound them everywhere; a pair whose estimate may lie in two slots is computed exactly.

Cosines are counted in even slots first, fine enough for most tables: the slot of a pair is the whole part of a scaled
product of unit vectors. A second look at all pairs lists those around the equal error rate and the least cost.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from inkprint.operators import intervals, pairs
from inkprint.session import settle

HEAD_SHIFT = 48  # the first counts go by sign, exponent and four more bits
SLOTS = 1 << 22
CHUNK_SLOTS = 1 << 16
LISTED = 1 << 22
STRIP_ROWS = 128  # queries by TILE_ROWS targets at a time: their scores stay in a core's cache
MOST_BITS = 4  # by which all slots are cut again at once
NEIGHBOURS = 1  # slots with pairs that are looked at on either side of the equal error rate, to begin with
EVEN_BITS = 20  # even slots of cosines that the driver holds are 2^-20 wide at least
FOLD_BITS = 4  # by which cells cut these
EVEN_WAVE = 8  # times `slots`: even slots that a cell counts at a time, of four bytes a class
FLAG_BITS = 16
LOW_BITS = np.int64(2 ** 63 - 1)


def keys_of(scores: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; what is not a number comes last."""
    if np.isnan(scores.sum()):
        scores = np.where(np.isnan(scores), np.nan, scores)
    bits = (scores + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & LOW_BITS)


def scores_of(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & LOW_BITS)).view(np.float64)


class Ranges:
    """Disjoint ranges of keys in their order; range i is cut into `slots[i]` slots of 2^`shift[i]` keys."""

    def __init__(self, start: np.ndarray, shift: np.ndarray, slots: np.ndarray) -> None:
        self.start, self.shift, self.slots = (x.astype(np.int64) for x in (start, shift, slots))
        self.last = self.start + ((self.slots << self.shift) - 1)
        self.base = np.cumsum(self.slots) - self.slots
        self.total = int(self.slots.sum())
        head = np.arange(-(1 << 15), 1 << 15) << HEAD_SHIFT
        at = np.searchsorted(self.start, head, "right") - 1
        # The range that holds all keys of a head, if one does.
        self.of_head = np.where((at >= 0) & (self.last[at] >= head + ((1 << HEAD_SHIFT) - 1)), at, -1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key. Keys between two ranges share a negative number, another one in every gap."""
        at = np.searchsorted(self.start, keys, "right") - 1
        held = (at >= 0) & (keys <= self.last[at])
        return np.where(held, self.base[at] + ((keys - self.start[at]) >> self.shift[at]), -2 - at)

    def between(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of two keys each; where they differ, only that they do."""
        at = self.of_head[(low >> HEAD_SHIFT) + (1 << 15)]
        start, shift, base = self.start[at], self.shift[at], self.base[at]
        first, last = base + ((low - start) >> shift), base + ((high - start) >> shift)
        other = np.flatnonzero(at < 0)
        if len(other):
            x, y = low.ravel()[other], high.ravel()[other]
            first.ravel()[other] = last.ravel()[other] = -1
            near = (y >= self.start[0]) & (x <= self.last[-1])
            first.ravel()[other[near]], last.ravel()[other[near]] = self.slot(x[near]), self.slot(y[near])
        return first, last

    def parts(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First key and shift of these slots."""
        at = np.searchsorted(self.base, slots, "right") - 1
        return self.start[at] + ((slots - self.base[at]) << self.shift[at]), self.shift[at]

    def even(self) -> tuple[int, np.ndarray, np.ndarray] | None:
        """(bits, ranges, first) if all slots but those next to zero or beyond 1 are 2^-`bits` wide and lie close together:
        which ranges have them, and the whole part of a score in the first slot of each, times 2^`bits`. It goes up by one
        from slot to slot."""
        size = np.where(self.start < 0, ~self.start, self.start)  # bits of the absolute value
        exponent = size >> 52
        fits = (self.start >> 52 == self.last >> 52) & (exponent > 0) & (exponent < 1023) & (self.shift <= 52)
        bits = np.where(fits, 1075 - exponent - self.shift, 0)
        if not (bits > 0).any():
            return None
        width = np.bincount(np.maximum(bits, 0), self.slots * (bits > 0)).argmax()
        at = np.flatnonzero(bits == width)
        first = ((size[at] & ((1 << 52) - 1)) | (1 << 52)) >> self.shift[at]
        first = np.where(self.start[at] < 0, -first, first)
        reach, least = (first + self.slots[at]).max() - first.min(), np.where(self.start[at] < 0, ~self.last[at], self.start[at]).min()
        dense = 2 * self.slots[at].sum() >= max(self.total, reach) and not (self.start[at] & ((1 << self.shift[at]) - 1)).any()
        other = np.delete(np.arange(len(self.start)), at)
        low, high = self.start[other], self.last[other]
        aside = (low >= 1023 << 52) | (high < -1023 << 52) | ((low >= -least) & (high < least))
        return (int(width), at, first) if dense and aside.all() else None

    def within(self, low: int, high: int) -> Ranges:
        """The slots that hold keys from `low` to `high`."""
        some = np.flatnonzero((self.last >= low) & (self.start <= high))
        start, shift, last = self.start[some], self.shift[some], self.last[some]
        skip, end = (np.maximum(start, low) - start) >> shift, (np.minimum(last, high) - start) >> shift
        return Ranges(start + (skip << shift), shift, end - skip + 1)


def every_head() -> Ranges:
    return Ranges(np.array([-2 ** 63, 0]), np.full(2, HEAD_SHIFT), np.full(2, 1 << 15))


def even_ranges(bits: int) -> Ranges:
    """All keys: slots of 2^-`bits` between -1 and 1, and one for every power of two beyond and next to zero."""
    one, least = 1023 << 52, (1023 - bits) << 52
    octave = np.arange(bits, dtype=np.int64)
    slots, shift = 1 << (bits - 1 - octave), 53 - bits + octave
    outer, inner = 2048 - 1023, 2 * (1023 - bits)
    return Ranges(np.r_[-2 ** 63, (octave << 52) - one, -least, one - ((octave[::-1] + 1) << 52), one],
                  np.r_[52, shift, 52, shift[::-1], 52], np.r_[outer, slots, inner, slots[::-1], outer])


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{len(data) // size}")).astype(np.int64)


def _between(ranges: Ranges, q: np.ndarray, t: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest slot in which the exact score of each pair may lie."""
    scores, slack = intervals.estimated_closeness(q, t, metric)
    if not np.isfinite(slack):
        return np.full(scores.shape, -1), np.full(scores.shape, -2)  # nothing is known of any pair
    low = keys_of(scores - slack)
    return ranges.between(low, keys_of(scores + slack) if slack else low)


class _Tiles:
    """The pairs of a cell, tile by tile. A cosine is estimated as a product of unit vectors, times a power of two, which
    rounds nothing."""

    def __init__(self, a: np.ndarray, b: np.ndarray, codes: tuple[np.ndarray, np.ndarray], bits: int | None) -> None:
        self.sides, self.codes, self.bits, self.step = (a, b), codes, bits, pairs.TILE_ROWS
        self.units = None
        if bits is not None:
            self.slack = (a.shape[1] + 8) * 2.0 ** (bits - 49)  # as in `intervals.estimated_closeness`
            sizes = [np.sqrt((x * x).sum(axis=1))[:, None] for x in (a, b)]
            odd = [~np.isfinite(n[:, 0]) for n in sizes]
            self.odd = any(x.any() for x in odd)
            # What is not finite counts as zero here, and what is next to zero is computed exactly.
            q, t = (np.divide(x, n, out=np.zeros_like(x), where=(n > 0) & np.isfinite(n)) for x, n in zip((a, b), sizes))
            self.units = q * 2.0 ** bits, t

    def each(self, found: _Slots | _Listed) -> None:
        (a, b), step = self.sides, self.step
        space = np.empty((2, STRIP_ROWS, step))
        for j in range(0, len(b), step):
            t = self.units and self.units[1][j:j + step].T
            for i in range(0, len(a), STRIP_ROWS):
                q, other = a[i:i + STRIP_ROWS], b[j:j + step]
                same = self.codes[0][i:i + STRIP_ROWS, None] == self.codes[1][None, j:j + step]
                if self.units is None or (self.odd and not found.ODD):
                    found.add(q, other, same)
                    continue
                scaled, left = (x.ravel()[:same.size].reshape(same.shape) for x in space)
                np.matmul(self.units[0][i:i + STRIP_ROWS], t, out=scaled)
                found.add_scaled(q, other, same, scaled, left, self.slack)


def _codes(q: pa.Table, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both sides as small numbers; a missing one is like no other."""
    sides = [s.column("label") for s in (q, t)]
    known = pc.unique(pa.chunked_array([c for s in sides for c in s.chunks], sides[0].type)).drop_null()
    return tuple(pc.fill_null(pc.index_in(s, known), missing).to_numpy().astype(np.int32) for s, missing in zip(sides, (-1, -2)))


class _Slots:
    """Counts the pairs of a cell by slot and class."""

    SCHEMA = "chunk int, pos binary, neg binary"
    ODD = True  # takes vectors that are not finite as zeros

    def __init__(self, ranges: Ranges, metric: str) -> None:
        self.ranges, self.metric = ranges, metric
        self.even = ranges.even() if metric == "cosine" else None
        self.bits = self.even and self.even[0]
        self.counts, self.table, self.single, self.held = None, None, [], 0

    def open(self, n_pairs: int) -> None:
        if self.even is None:
            return
        _, at, first = self.even
        self.first, self.n = int(first.min()), int((first + self.ranges.slots[at]).max() - first.min())
        self.whole = self.first + self.n == 1 - self.first == 1 << self.bits
        # Next to zero slots have other widths, if they are asked for.
        zero = (self.ranges.start < 1023 << 52) & (self.ranges.last >= -1023 << 52)
        zero[at] = False
        self.inner = float(np.where(first < 0, 1 - first - self.ranges.slots[at], first).min()) if zero.any() else 0.0
        # The last places take what is counted elsewhere, and a score of one as estimated lies beyond the slots.
        self.table = np.zeros(2 * self.n + 4, np.uint32 if n_pairs < 1 << 32 else np.int64)
        self.ones = np.ones(STRIP_ROWS * pairs.TILE_ROWS, self.table.dtype)

    def add(self, q: np.ndarray, t: np.ndarray, same: np.ndarray) -> None:
        if self.counts is None:
            self.counts = np.zeros(2 * self.ranges.total, np.int64)
        slots, high = _between(self.ranges, q, t, self.metric)
        rows, columns = np.nonzero(slots != high)
        slots[rows, columns] = self.ranges.slot(keys_of(intervals._exact_pairs(q, t, rows, columns, self.metric)))
        found = 2 * slots + same
        np.add.at(self.counts, found[slots >= 0] if slots.min(initial=0) < 0 else found.ravel(), 1)

    def add_scaled(self, q: np.ndarray, t: np.ndarray, same: np.ndarray, scaled: np.ndarray, left: np.ndarray, slack: float) -> None:
        at = scaled.astype(np.int64)
        np.abs(np.subtract(scaled, np.rint(scaled, out=left), out=left), out=left)
        near = left <= slack
        if self.inner:
            near |= np.abs(scaled, out=left) < self.inner
        at -= self.first
        if near.any():
            rows, columns = np.nonzero(near)
            slots = self.ranges.slot(keys_of(intervals._exact_pairs(q, t, rows, columns, self.metric)))
            self._keep((2 * slots + same[rows, columns])[slots >= 0])
            at[near] = self.n + 1
        if not self.whole:
            np.minimum(at.view(np.uint64), np.uint64(self.n + 1), out=at.view(np.uint64))  # below the first slot, too
        at *= 2
        at += same
        np.add.at(self.table, at.ravel(), self.ones[:at.size])

    def _keep(self, found: np.ndarray) -> None:
        self.single.append((found, np.ones(len(found), np.int64)))
        self.held += len(found)
        if self.held > SLOTS:
            self.single = [self._singles()]
            self.held = len(self.single[0][0]) // 2

    def _singles(self) -> tuple[np.ndarray, np.ndarray]:
        found, counts = (np.concatenate(x) for x in zip(*self.single, (np.zeros(0, np.int64),) * 2))
        values, at = np.unique(found, return_inverse=True)
        return values, np.bincount(at, counts, len(values)).astype(np.int64)

    def result(self) -> pa.Table:
        rows, (single, n_single) = [], self._singles()
        for i in range(0, self.ranges.total, CHUNK_SLOTS):
            end = min(i + CHUNK_SLOTS, self.ranges.total)
            part = self.counts[2 * i:2 * end] if self.counts is not None else np.zeros(2 * (end - i), np.int64)
            x, y = np.searchsorted(single, (2 * i, 2 * end))
            part[single[x:y] - 2 * i] += n_single[x:y]
            if self.table is not None:
                _, which, first = self.even
                base = self.ranges.base[which]
                some = np.flatnonzero((base < end) & (base + self.ranges.slots[which] > i))
                for b, n, f in zip(base[some].tolist(), self.ranges.slots[which][some].tolist(), (first - self.first)[some].tolist()):
                    low, high = max(b, i), min(b + n, end)
                    part[2 * (low - i):2 * (high - i)] += self.table[2 * (f + low - b):2 * (f + high - b)]
            if part.any():
                rows.append((i // CHUNK_SLOTS, _packed(part[1::2]), _packed(part[::2])))
        chunk, pos, neg = zip(*rows) if rows else ((), (), ())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "pos": pa.array(pos, pa.binary()), "neg": pa.array(neg, pa.binary())})


class _Listed:
    """The exact scores of a cell's pairs within the ranges."""

    SCHEMA = "score double, pos bigint, neg bigint"
    ODD = False

    def __init__(self, ranges: Ranges, metric: str) -> None:
        self.ranges, self.metric = ranges, metric
        self.bits = FLAG_BITS if metric == "cosine" else None
        self.scores, self.same = [np.zeros(0)], [np.zeros(0, bool)]

    def open(self, n_pairs: int) -> None:
        """Flags for the scores that may lie in a range, by the whole part of the scaled score."""
        if self.bits:
            top = 1 << self.bits
            ends = [np.where(np.isnan(scores_of(x)), np.sign(x), np.clip(scores_of(x), -1.0, 1.0)) for x in (self.ranges.start, self.ranges.last)]
            low, high = ((x * top).astype(np.int64) + top for x in ends)
            marks = np.zeros(2 * top + 4, np.int64)
            np.add.at(marks, np.maximum(low - 1, 0), 1)
            np.add.at(marks, high + 2, -1)
            self.flags = np.cumsum(marks) > 0

    def _take(self, q: np.ndarray, t: np.ndarray, same: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        exact = intervals._exact_pairs(q, t, rows, columns, self.metric)
        inside = self.ranges.slot(keys_of(exact)) >= 0
        self.scores.append(exact[inside])
        self.same.append(same[rows, columns][inside])

    def add(self, q: np.ndarray, t: np.ndarray, same: np.ndarray) -> None:
        low, high = _between(self.ranges, q, t, self.metric)
        self._take(q, t, same, *np.nonzero((low >= 0) | (low != high)))

    def add_scaled(self, q: np.ndarray, t: np.ndarray, same: np.ndarray, scaled: np.ndarray, left: np.ndarray, slack: float) -> None:
        top = 1 << self.bits
        at = scaled.astype(np.int64)
        at += top
        rows, columns = np.nonzero(self.flags[at])
        if len(rows):
            score = scaled[rows, columns]
            low, high = (self.ranges.slot(keys_of((score + x) / top)) for x in (-slack, slack))
            some = (low >= 0) | (low != high)
            self._take(q, t, same, rows[some], columns[some])

    def result(self) -> pa.Table:
        scores, at = np.unique(np.concatenate(self.scores), return_inverse=True)
        same = np.concatenate(self.same)
        count = lambda which: np.bincount(at[which], minlength=len(scores)).astype(np.int64)
        return pa.table({"score": scores, "pos": count(same), "neg": count(~same)})


SLOT = [("start", "i8"), ("shift", "i1"), ("pos", "i8"), ("neg", "i8"), ("gain", "f8"), ("unsure", "f8")]


def _state(start: np.ndarray, shift: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Slots as records. Twice the wins inside a slot are `pos` * `neg` + `gain`, give or take `unsure`."""
    out = np.zeros(len(start), SLOT)
    out["start"], out["shift"], out["pos"], out["neg"] = start, shift, pos, neg
    out["unsure"] = np.where(out["shift"] > 0, out["pos"].astype(float) * out["neg"], 0.0)
    return out


def _folded(slots: np.ndarray, bits: int) -> np.ndarray:
    """2^`bits` neighbours as one slot that knows more of its wins than its counts say."""
    fine = slots.reshape(-1, 1 << bits)
    pos, neg = fine["pos"].astype(float), fine["neg"].astype(float)
    out = _state(fine["start"][:, 0], fine["shift"][:, 0] + bits, fine["pos"].sum(axis=1), fine["neg"].sum(axis=1))
    below = np.cumsum(neg, axis=1) - neg
    out["gain"] = (pos * (2 * below + neg)).sum(axis=1) - out["pos"].astype(float) * out["neg"]
    out["unsure"] = fine["unsure"].sum(axis=1)
    return out


class _Pairs:
    """All pairs of two sides, block by block."""

    def __init__(self, queries: DataFrame, targets: DataFrame, metric: str, block_rows: int | None) -> None:
        self.sides = [settle(s.select("id", "label", "vec")) for s in (queries, targets)]
        self.metric = metric
        self.grid = pairs.grid(*self.sides, block_rows)

    def count(self) -> int:
        return math.prod(s.count() for s in self.sides)

    def _cells(self, make: type, ranges: Ranges) -> DataFrame:
        n_left, n_right, tasks = self.grid
        metric, keys = self.metric, ["_i", "_j"]
        every_i, every_j = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_left, n_right))
        left = self.sides[0].withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int")).withColumn("_j", every_j)
        right = self.sides[1].withColumn("_j", F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int")).withColumn("_i", every_i)
        shared = left.sparkSession.sparkContext.broadcast(ranges)

        def cell(q: pa.Table, t: pa.Table) -> pa.Table:
            found = make(shared.value, metric)
            if q.num_rows and t.num_rows:
                found.open(q.num_rows * t.num_rows)
                _Tiles(pairs._matrix(q, "vec"), pairs._matrix(t, "vec"), _codes(q, t), found.bits).each(found)
            return found.result()

        # Most cells get a partition of their own.
        partitions = min(8 * n_left * n_right, max(4 * tasks, pairs.MAX_PARTITIONS))
        left, right = (s.toDF(*s.columns).repartition(partitions, *keys) for s in (left, right))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, make.SCHEMA)

    def counted(self, ranges: Ranges, fold: int = 0) -> np.ndarray:
        """The slots that hold pairs, as `_state`. 2^`fold` neighbouring slots of a range
        are given as one, with what is known of the wins inside of it."""
        sizes = {i // CHUNK_SLOTS: min(CHUNK_SLOTS, ranges.total - i) for i in range(0, ranges.total, CHUNK_SLOTS)}
        shared = self.sides[0].sparkSession.sparkContext.broadcast(ranges)

        def merged(cells: pa.Table) -> pa.Table:
            chunk = cells.column("chunk")[0].as_py()
            pos, neg = (sum(_unpacked(x, sizes[chunk]) for x in cells.column(c).to_pylist()) for c in ("pos", "neg"))
            if fold:
                one = _folded(_state(*shared.value.parts(np.arange(len(pos)) + chunk * CHUNK_SLOTS), pos, neg), fold)
                out = [_packed(one["pos"]), _packed(one["neg"]), one["gain"].tobytes(), one["unsure"].tobytes()]
            else:
                out = [_packed(pos), _packed(neg), b"", b""]
            return pa.table([pa.array([chunk], pa.int32()), *[pa.array([x], pa.binary()) for x in out]], ["chunk", "pos", "neg", "gain", "unsure"])

        parts = [_state(*np.zeros((4, 0), np.int64))]
        # One row per chunk of slots.
        for row in self._cells(_Slots, ranges).groupBy("chunk").applyInArrow(
                merged, _Slots.SCHEMA + ", gain binary, unsure binary").collect():
            first = np.arange(0, sizes[row.chunk], 1 << fold)
            pos, neg = (_unpacked(bytes(x), len(first)) for x in (row.pos, row.neg))
            start, shift = ranges.parts(first + row.chunk * CHUNK_SLOTS)
            one = _state(start, shift + fold, pos, neg)
            if fold:
                one["gain"], one["unsure"] = np.frombuffer(row.gain), np.frombuffer(row.unsure)
            parts.append(one[(pos + neg) > 0])
        return np.concatenate(parts)

    def listed(self, ranges: Ranges) -> np.ndarray:
        """The same for the single scores within the ranges, which have no more than LISTED pairs."""
        rows = self._cells(_Listed, ranges).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
        score, pos, neg = (rows.column(c).to_numpy() for c in ("score", "pos", "neg"))
        return _state(keys_of(score), np.zeros(len(score)), pos, neg)


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact sum of products beyond 64 bits."""
    return (int((a * (b >> 24)).sum()) << 24) + int((a * (b & ((1 << 24) - 1))).sum())


class Bracket:
    """What the counts of slots say about the metrics. Slots go from the best score downward."""

    def __init__(self, slots: np.ndarray, costs: tuple[float, float, float]) -> None:
        self.start, self.pos, self.neg, self.unsure = (slots[c] for c in ("start", "pos", "neg", "unsure"))
        self.gain = float(slots["gain"].sum())
        true_pos, false_pos = np.cumsum(self.pos), np.cumsum(self.neg)
        self.n_pos, self.n_neg = int(true_pos[-1]), int(false_pos[-1])
        self.true_pos, self.false_pos, self.costs = true_pos, false_pos, costs
        self.wide = slots["shift"] > 0

    def area(self) -> tuple[float, float, float]:
        """Least, middle and greatest area; a tie counts half."""
        wins = 2 * _dot(self.pos, self.n_neg - self.false_pos) + _dot(self.pos, self.neg) + round(self.gain)
        unsure = math.ceil(self.unsure.sum())
        whole = 2 * self.n_pos * self.n_neg
        return (wins - unsure) / whole, wins / whole, (wins + unsure) / whole

    def cost(self) -> tuple[float, float, np.ndarray]:
        """Least possible and least known cost, and the slots that may hold a smaller one than is known."""
        p_target, c_miss, c_fa = self.costs
        unit = min(c_miss * p_target, c_fa * (1.0 - p_target))
        missed, alarms = self.n_pos - self.true_pos + self.pos, (self.false_pos - self.neg) / self.n_neg
        price = lambda misses: (c_miss * (misses / self.n_pos) * p_target + c_fa * alarms * (1.0 - p_target)) / unit
        known = float(price(missed).min())
        # A slot without other-author pairs is cheapest at its end, where the next one begins.
        open_ = self.wide & (self.neg > 0)
        open_[-1] = self.wide[-1]
        possible = np.where(open_, price(missed - self.pos), np.inf)
        return min(known, float(possible.min())), known, np.flatnonzero(possible < known)

    def window(self, reach: int) -> tuple[int, int]:
        """Slots around the point where the error rates cross."""
        crossed = 1.0 - self.false_pos / self.n_neg - self.true_pos / self.n_pos <= 0
        at = int(np.argmax(crossed))
        return max(0, at - reach), min(len(self.pos), at + reach + 1)

    def unsettled(self, first: int, end: int) -> np.ndarray:
        """Slots whose points of the curve are not known: neither other-author pairs alone nor one pair."""
        part = slice(first, end)
        return first + np.flatnonzero(self.wide[part] & (self.pos[part] > 0) & (self.pos[part] + self.neg[part] > 1))

    def equal_error(self, first: int, end: int) -> tuple[float, float] | None:
        """Both equal error rates from settled slots, None if corners of the curve on either side lie further out."""
        rows: list[list[int]] = []  # pos, neg, true_pos, false_pos; a stretch of other-author pairs is one row
        for p, n, t, f in zip(*(x[first:end].tolist() for x in (self.pos, self.neg, self.true_pos, self.false_pos))):
            if rows and not p and not rows[-1][0]:
                rows[-1] = [0, rows[-1][1] + n, t, f]
            else:
                rows.append([p, n, t, f])
        best, sides, crossing = (1.0, 0.0), [first == 0, False], None
        for i, (p, n, t, f) in enumerate(rows):
            tpr, fpr = t / self.n_pos, f / self.n_neg
            t0, f0 = (t - p) / self.n_pos, (f - n) / self.n_neg
            ahead = 1.0 - f0 - t0
            if ahead > 0 and 1.0 - fpr - tpr <= 0:
                crossing = max(crossing or 0.0, f0 + (fpr - f0) * ahead / ((fpr - f0) + (tpr - t0)))
            if i + 1 == len(rows) and end < len(self.pos):
                continue  # what comes next is not known
            if (i == 0 and first == 0) or i + 1 == len(rows) or rows[i + 1][:2] != [p, n]:
                sides[1.0 - fpr - tpr <= 0] = True
                gap = abs((1.0 - tpr) - fpr)
                best = min(best, (gap, fpr), key=lambda x: x[0])
        return (best[1], crossing) if all(sides) else None


def _rounded(x: float, places: int) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def _cut(shift: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """Bits by which to cut each slot: new slots in proportion to the weights, at least two."""
    weight = weight / weight.sum()
    bits = lambda factor: np.minimum(shift, np.maximum(1, np.floor(np.log2(np.maximum(weight * factor, 1.0))))).astype(np.int64)
    fits = [f for f in slots * 2.0 ** np.arange(0, 1, 0.125) if (1 << bits(f)).sum() <= slots]
    return bits(max(fits, default=slots / 2))


def link_metrics(queries: DataFrame, targets: DataFrame, metric: str = "cosine", places: int = 6,
                 p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, block_rows: int | None = None,
                 slots: int = SLOTS, listed: int = LISTED) -> DataFrame:
    """The metrics of `verification.metrics_from_counts` over `intervals.interval_counts`: the equal error rates as there,
    the area and the least cost such that rounding to `places` gives what rounding the exact value gives."""
    if metric not in pairs.SIMILARITIES + pairs.DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; choose one of {pairs.SIMILARITIES + pairs.DISTANCES}")
    if "vec" not in queries.columns:
        raise ValueError("exact counts need dense vectors; sparse ones are compared on a grid of `decimals`")
    row = _link_metrics(_Pairs(queries, targets, metric, block_rows), places, (p_target, c_miss, c_fa), slots, listed)
    return queries.sparkSession.createDataFrame([row], "auc_roc double, eer double, eer_v2 double, min_dcf double")


def _waves(ranges: Ranges, bits: int, slots: int) -> list[Ranges]:
    """All slots of `ranges` cut into 2^`bits` each, about `slots` of them at a time."""
    most = max(1, (slots >> bits) // 4)
    pieces = -(-ranges.slots // most)
    at = np.repeat(np.arange(len(pieces)), pieces)
    skip = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    start, shift = ranges.start[at] + (skip << ranges.shift[at]), ranges.shift[at] - bits
    count = np.minimum(most, ranges.slots[at] - skip) << bits
    total = int(count.sum())
    wave = (np.cumsum(count) - count) * math.ceil(total / (1.0625 * slots)) // total
    return [Ranges(start[wave == n], shift[wave == n], count[wave == n]) for n in np.unique(wave)]


def _finer(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """What is known once these slots were cut and folded again."""
    known = known[np.argsort(known["start"])]
    at = np.minimum(np.searchsorted(known["start"], found["start"]), len(known) - 1)
    here = (known["start"][at] == found["start"]) & (known["shift"][at] == found["shift"])
    for c in ("gain", "unsure"):
        known[c][at[here]] = found[c][here]
    return known


def _first_counts(every: _Pairs, slots: int, listed: int) -> tuple[np.ndarray, Ranges | None, int]:
    """What the first look at all pairs tells, and the slots by which it went if they are even."""
    n_pairs = every.count()
    if n_pairs <= listed // 4:
        return every.listed(every_head()), None, 0
    if every.metric != "cosine":
        return every.counted(every_head()), None, 0
    ranges = even_ranges(min(EVEN_BITS, max(8, n_pairs.bit_length() - 8)))
    found = [every.counted(w, FOLD_BITS) for w in _waves(ranges, FOLD_BITS, EVEN_WAVE * slots)]
    return np.concatenate(found), ranges, FOLD_BITS


def _link_metrics(every: _Pairs, places: int, costs: tuple, slots: int, listed: int) -> tuple:
    known, first_cut, bits = _first_counts(every, slots, listed)
    reach, waves, even = NEIGHBOURS, [], first_cut is not None
    if not (known["pos"].any() and known["neg"].any()):
        return None, 0.0, None, None  # a class is empty: there are no rates
    while True:
        known = known[np.argsort(known["start"])[::-1]]
        state = Bracket(known, costs)
        least, area, most = state.area()
        cheapest, cost, cheap = state.cost()
        first, end = state.window(reach)
        near = state.unsettled(first, end)
        rates = None if len(near) else state.equal_error(first, end)
        if not len(near) and rates is None:
            reach *= 4
            continue
        weight = np.zeros(len(known))
        if _rounded(least, places) != _rounded(most, places):
            order = np.argsort(state.unsure)[::-1][:slots // 8]
            left = state.unsure.sum() - np.cumsum(state.unsure[order])
            spare = 0.02 * 10.0 ** -places * state.n_pos * state.n_neg
            chosen = order[:int((left > spare).sum()) + 1]
            few = min(len(order), max(1, len(known) // 16)) if even else len(chosen)
            if not waves and first_cut is not None and left[few - 1] > 0.5 * state.unsure.sum():
                # Many slots hold a little each: all are cut, as far as the distance to where rounding changes asks for.
                distance = abs(area * 10.0 ** places % 1 - 0.5) / 10.0 ** places
                more = min(MOST_BITS, 1 + int(math.log2(max(1.0, 1.25 * (most - area) / max(distance, 1e-300)))))
                if bits + more <= min(16, first_cut.shift.min()):
                    bits += more
                    part = np.cumsum(state.unsure) / state.unsure.sum()
                    high, low = (known[np.searchsorted(part, x)] for x in (0.0005, 0.9995))
                    held = first_cut.within(int(low["start"]), int(high["start"]) + (1 << int(high["shift"])) - 1)
                    waves = _waves(held, bits, (EVEN_WAVE if even else 2) * slots)
            if waves:
                known = _finer(known, every.counted(waves.pop(), bits))
                continue
            weight[chosen] = np.sqrt(state.unsure[chosen])
            weight /= weight.sum()
        if _rounded(cheapest, places) != _rounded(cost, places):
            cheap = cheap[:slots // 8]
            weight[cheap] += 0.1 / len(cheap)
        if len(near):
            near = near[:slots // 8]
            weight[near] += 0.1 / len(near)
        chosen = np.flatnonzero(weight)
        if not len(chosen):
            return area, *rates, cost
        chosen = chosen[::-1]  # ranges go upward
        start, shift = known["start"][chosen], known["shift"][chosen].astype(np.int64)
        if int(known["pos"][chosen].sum() + known["neg"][chosen].sum()) <= listed:
            found = every.listed(Ranges(start, shift, np.ones(len(chosen))))
        else:
            cut = _cut(shift, weight[chosen], slots)
            ranges = Ranges(start, shift - cut, 1 << cut)
            first_cut = first_cut or ranges
            found = every.counted(ranges)
        known = np.concatenate([np.delete(known, chosen), found])
