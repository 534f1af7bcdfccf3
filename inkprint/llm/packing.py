"""Packing token sequences into windows: bounded-space online best fit."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkprint.session import settle, spread

OPEN_WINDOWS = 64
CACHE_WORDS = 1 << 19
PART = 1 << 18
FAN_IN = 32
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes follow from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts as 32-bit words in bytes, for a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary is run by `tiktoken`, which gives the same ids several times faster. In its splitting rule a
    single space between two other characters always starts a new unit, so a text is encoded unit by unit and frequent
    units come from a table of bounded size. With `added`, the file's added tokens in a text get their own ids, as the
    library gives them; otherwise they are ordinary characters.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        marks = {t["content"]: t for t in content["added_tokens"]}
        tokens = marks if added else {}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens.values()):
            raise ValueError("added tokens that take in white space or depend on their neighbours")
        self.added = {c: np.array([t["id"]], "<u4").tobytes() for c, t in tokens.items()}
        longest = sorted(map(re.escape, tokens), key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(longest)})") if tokens else None
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()
                 if token not in marks and all(c in byte_of for c in token)}
        self.encode_part = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode_part(text), "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        first, *units = text.split(" ")
        got = list(map(self.known.get, units))
        if None in got or first[-1:].isspace():
            missing = {u for u, g in zip(units, got, strict=True) if g is None}
            if first[-1:].isspace() or any(not u or u[0].isspace() or u[-1].isspace() for u in missing):
                # White space next to a space: only single spaces between other characters are cuts.
                return b"".join(map(self._ids, _SINGLE.split(text)[:1])) + b"".join(
                    self._ids(" " + u) for u in _SINGLE.split(text)[1:])
            new = {u: self._ids(" " + u) for u in missing}
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
            self.known.update(new)
            got = [new[u] if g is None else g for u, g in zip(units, got, strict=True)]
        return self._ids(first) + b"".join(got)

    def encode(self, text: str) -> bytes:
        if not self.at_added or not self.at_added.search(text):
            return self._ordinary(text)
        return b"".join(self.added[x] if i % 2 else self._ordinary(x) for i, x in enumerate(self.at_added.split(text)))

    def _ordinary(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _SINGLE.search(text, at + PART) if len(text) > at + PART else None
            end = cut.start() if cut else len(text)
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


class Windows:
    """A fixed number of open windows; pieces go where they leave the least room."""

    def __init__(self, size: int, count: int) -> None:
        self.size, self.count, self.room, self.held, self.next = size, count, [], {}, 0

    def place(self, piece: list) -> list | None:
        """Put a piece (its length first) best-fit, in a new window if it fits in none; return the window if now full."""
        n = piece[0]
        at = bisect_left(self.room, (n, -1))
        if at < len(self.room):
            room, key = self.room.pop(at)
        else:
            room, key = self.size, self.next
            self.held[key] = []
            self.next += 1
        self.held[key].append(piece)
        if room == n:
            return self.held.pop(key)
        insort(self.room, (room - n, key))
        return None

    def rest(self) -> list[list]:
        """Pieces of the open windows, the fullest window first."""
        return [p for _, k in self.room for p in self.held[k]]


FIELDS = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, "
          "task bigint, window bigint, offset bigint")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("window", pa.int64()),
                     ("offset", pa.int64())])


class _Writer:
    """Rows of finished windows (with a number) and of open ones (number null)."""

    def __init__(self, keep_ids: bool) -> None:
        from pyspark import TaskContext

        self.keep, self.task, self.window, self.rows = keep_ids, TaskContext.get().partitionId(), 0, []

    def close(self, pieces: list) -> None:
        offset = 0
        for n, doc, start, total, ids in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, ids if self.keep else None, self.task, self.window,
                              offset))
            offset += n
        self.window += 1

    def leave(self, pieces: list) -> None:
        for n, doc, start, total, ids in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, ids, self.task, None, None))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in _SCHEMA]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)],
                                         schema=_SCHEMA)
        self.rows = []
        return out


def _pack(pieces: Iterator[list], size: int, count: int, keep_ids: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Place pieces of at most `size` ids; when none fits, the fullest window is topped up with a cut and emitted."""
    windows, out = Windows(size, count), _Writer(keep_ids)
    for piece in pieces:
        todo = [piece]
        if len(windows.room) == count and windows.room[-1][0] < piece[0] < size:
            todo = _cut(piece, windows.room[0][0])
        for part in todo:
            if part[0] == size:
                out.close([part])
            elif full := windows.place(part):
                out.close(full)
        if len(out.rows) >= 4096:
            yield out.batch()
    left = windows.rest()
    if not last:
        out.leave(left)
    for part in _merged(left, size) if last else []:
        out.close(part)
    yield out.batch()


def _cut(piece: list, at: int) -> tuple[list, list]:
    n, doc, start, total, ids = piece
    return [at, doc, start, total, ids[:4 * at]], [n - at, doc, start + at, total, ids[4 * at:]]


def _merged(pieces: list, size: int) -> Iterator[list]:
    """What is left at the end in full windows, then in sequences whose length is a power of two: no padding."""
    left = list(reversed(pieces))
    total = sum(p[0] for p in pieces)
    while total:
        need = min(size, 1 << (total.bit_length() - 1)) if total < size else size
        total -= need
        group = []
        while need:
            piece = left.pop()
            if piece[0] > need:
                piece, tail = _cut(piece, need)
                left.append(tail)
            group.append(piece)
            need -= piece[0]
        yield group


def _first(path: str, size: int, count: int, keep_ids: bool, end_id: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)

        def pieces() -> Iterator[list]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode.encode(text.as_py() or "") + end
                    total = len(ids) // 4
                    for at in range(0, total, size):
                        part = ids[4 * at:4 * (at + size)]
                        yield [len(part) // 4, doc, at, total, part]

        yield from _pack(pieces(), size, count, keep_ids, False)

    return run


def _again(size: int, count: int, keep_ids: bool, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[list]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield [r["length"], r["doc_id"], r["start"], r["doc_tokens"], r["ids"]]

        yield from _pack(pieces(), size, count, keep_ids, last)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, open_windows: int = OPEN_WINDOWS, end_id: int = 0,
         keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents placed in windows of at most `window` token ids.

    Columns: doc_id, start, length (the piece: its document's ids start .. start + length), ids (32-bit little-endian
    words; null without `keep_ids`), ids_crc32, doc_tokens, sequence_id, offset (place in the sequence, gapless from 0).

    Every task reads its documents once and keeps `open_windows` windows. Whole windows of a long document stand alone;
    the rest of a document goes where it leaves the least room. When it fits nowhere and no more windows may open, its first ids fill up
    the fullest window, which is emitted. The open windows of all tasks are merged by the same rule, `FAN_IN` tasks at a time, so
    what remains is bounded in every step; the last few are cut to lengths that are powers of two, which need no padding.

    Defined cases: added tokens of the file within a text get their ids; a null or empty text is the end id alone; rows that repeat a doc_id are separate documents; null ids
    stay null; an empty table gives no rows; other columns are ignored.
    """
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    made = settle(rows.mapInArrow(_first(tokenizer, window, open_windows, keep_ids, end_id), FIELDS), "zstd")
    parts, tasks, step = [], rows.rdd.getNumPartitions(), 0
    while True:
        parts.append(made.where("window is not null").withColumn("step", F.lit(step)))
        left = made.where("window is null")
        if step and tasks == 1:
            break
        tasks = max(1, -(-tasks // FAN_IN))
        groups = left.coalesce(1) if tasks == 1 else left.repartition(tasks, F.floor(F.col("task") / FAN_IN))
        joined = groups.sortWithinPartitions("task", "doc_id", "start")
        step += 1
        made = settle(joined.mapInArrow(_again(window, open_windows, keep_ids, tasks == 1), FIELDS), "zstd")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    number = (F.col("step").cast("bigint") * (1 << 58)) + F.col("task") * (1 << 34) + F.col("window")
    return out.select("doc_id", "start", "length", *(["ids"] if keep_ids else []), "ids_crc32", "doc_tokens",
                      number.alias("sequence_id"), "offset")
