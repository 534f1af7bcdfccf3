"""Runs of repeated words: maximal stretches with a smallest period, found through a suffix automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.llm.automaton import SuffixAutomaton
from inkprint.llm.common import mix
from inkprint.session import spread

LEAST = 12
Run = tuple[int, int, int]  # start, length, period


class LastEnds:
    """Where the strings that end at each place of a sequence ended before: link-cut access on an automaton's link tree.

    The path from a prefix's state to the root holds all strings that end there. An access gives the whole path the
    colour of the present place; what it passes are the segments of older colours. As the tree is complete before the
    first access, its preferred paths run along heavy paths and are kept as one stack of (string length at the lower
    end, colour) per heavy path, the segment next to the root on top: an access adds one segment for each of its at most
    log2(n) heavy paths and removes each segment once.
    """

    def __init__(self, automaton: SuffixAutomaton) -> None:
        self.length = length = automaton.length
        link = automaton.link
        n = len(link)
        order = np.argsort(np.array(length), kind="stable").tolist()  # every state after its link
        weight, heavy = [1] * n, [0] * n
        for state in reversed(order[1:]):
            up = link[state]
            weight[up] += weight[state]
            if not heavy[up] or weight[state] > weight[heavy[up]]:
                heavy[up] = state
        self.head = head = list(range(n))
        for state in order[1:]:
            if heavy[link[state]] == state:
                head[state] = head[link[state]]
        self.above = [link[h] for h in head]
        self.stacks: list[list[tuple[int, int]]] = [[] if h == s else None for s, h in enumerate(head)]

    def access(self, state: int, place: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from `state` to the root; yields (longest string, its previous end) of each segment."""
        length, head, above, stacks = self.length, self.head, self.above, self.stacks
        while state >= 0:
            stack, depth = stacks[head[state]], length[state]
            while stack:
                lower, end = stack[-1]
                if lower > depth:
                    yield depth, end
                    break
                yield lower, end
                stack.pop()
                if lower == depth:
                    break
            stack.append((depth, place))
            state = above[state]


def runs_of(words: list[int], least: int = LEAST) -> list[Run]:
    """All maximal stretches (start, length, smallest period q) of length >= max(least, 2 q), by start, then period.

    When the suffix of length h at place i ended at e before and i - e <= h, the last h + i - e words have period i - e,
    which no shorter period underlies (its shift would have ended later): a square. The longest such h reaches back to
    the start of the run; comparing words carries it forward, once a run.
    """
    automaton = SuffixAutomaton()
    states = automaton.add(words)
    ends = LastEnds(automaton)
    known: dict[int, int] = {}  # last word of the latest run of each period
    out, n = [], len(words)
    for i, state in enumerate(states):
        for h, end in ends.access(state, i):
            q = i - end
            if h >= q and known.get(q, -1) < i:
                j = i + 1
                while j < n and words[j] == words[j - q]:
                    j += 1
                known[q] = j - 1
                start = i + 1 - h - q
                if j - start >= max(least, 2 * q):
                    out.append((start, j - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _covered(ids: np.ndarray, gram: int) -> np.ndarray:
    """Words inside a word sequence of `gram` words that the text holds twice. A run of 2 x gram words and more lies in
    such words, so only their stretches need an automaton; equal hashes of unequal sequences cost time, nothing else."""
    n = len(ids) - gram + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(gram if n > 1 else 0):
        h = mix(h + ids[j:j + n].astype(np.uint64) + np.uint64(1))
    found = np.zeros(len(ids) + 1, np.int64)
    if n > 1:
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        np.add.at(found, at, 1)
        np.add.at(found, at + gram, -1)
    return np.cumsum(found[:-1]) > 0


def find(words: list[bytes], least: int = LEAST) -> list[Run]:
    """The runs of a whole text."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words))
    inside = _covered(ids, -(-least // 2))
    if not inside.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [(start + int(a), length, q) for a, b in zip(edge[::2], edge[1::2])
            for start, length, q in runs_of(ids[a:b].tolist(), least)]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                rows = batch.slice(part, 1024)
                counts, runs, texts = [], [], []
                for text in rows.column(0):
                    words = (text.as_py() or "").encode().split()  # at ASCII white space: x09 to x0D and x20
                    found = find(words, least)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(collapse(words, found).decode())
                made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *made],
                                                 names=[*rows.schema.names[1:], "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The columns `keep` of every document with `n_words`, `runs` (array of start, length, period in words, by start,
    then period) and `collapsed`, the words outside all repetitions.

    Words are separated by ASCII white space and compared byte by byte. A run is a stretch of at least max(least, 2 q)
    words with smallest period q that cannot be extended to either side. Words of a run beyond its first q are left out
    of `collapsed`. Every text is read once, whole, by one task; time grows with n log n, whatever repeats.

    Defined cases: a null, empty or white text has no words, no runs and an empty `collapsed`; rows that repeat an id are
    separate documents; nulls in kept columns stay null; kept columns may have any name but those added; an empty table
    gives no rows.
    """
    place = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(p) for c, p in zip(keep, place, strict=True)])
    kinds = [f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(keep, place, strict=True)]
    out = spread(given, *place[:1]).mapInArrow(_scan(least), ", ".join(
        [*kinds, "n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]))
    return out.select(*[F.col(p).alias(c) for c, p in zip(keep, place, strict=True)], "n_words", "runs", "collapsed")
