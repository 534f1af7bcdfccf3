"""Removal of repeated byte windows by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from inkprint.llm.common import mix, window_hashes
from inkprint.session import settle, spread

WINDOW = 50
CHUNK_BYTES = 1 << 19  # compressed, a row stays well below half a megabyte
BUCKET_BYTES = 16 << 20
HOT_CHUNKS = 4096
BROADCAST_BYTES = 32 << 20
BLOCK = 1 << 18
PLACE = np.uint64(26)  # low bits of a sort value that hold a position in a block
LAST = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Runs of neighbouring windows with the same anchor: the anchor's position, its hash, first and last window start,
    and the document's number in the chunk."""

    at: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def anchor_width(window: int) -> int:
    return window // 2


def find_runs(data: np.ndarray, sizes: np.ndarray, window: int) -> Runs:
    """The anchor of a window is its substring of half the length whose hash is least, the leftmost of equals. It is
    chosen by the window's bytes alone, so equal windows have equal anchors at the same place."""
    k = anchor_width(window)
    span = window - k + 1
    ends = np.cumsum(sizes)
    found = []
    for begin in range(0, max(0, len(data) - window + 1), BLOCK):
        end = min(begin + BLOCK, len(data) - window + 1)
        grams = window_hashes(data[begin:end + window - 1], k)
        best = grams >> PLACE << PLACE | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have < span:  # minimum over `span` neighbours by doubling
            step = min(have, span - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        start = np.arange(end - begin)
        doc = np.searchsorted(ends, start + begin, side="right")
        ok = start + begin + window <= ends[np.minimum(doc, len(ends) - 1)]
        start, doc = start[ok], doc[ok]
        at = (best[start] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        stop = np.r_[new[1:], len(start)] - 1
        # Anchors have small hashes; mixed again, they spread over all buckets.
        found.append((at[new] + begin, mix(grams[at[new]]), start[new] + begin, start[stop] + begin, doc[new]))
    if not found:
        none = np.empty(0, np.int64)
        return Runs(none, none.astype(np.uint64), none, none, none)
    return Runs(*[np.concatenate(x) for x in zip(*found, strict=True)])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


@dataclass
class Anchors:
    """Distinct anchors of a chunk in the order (bucket, fingerprint), and the place of each run's anchor there."""

    bucket: np.ndarray
    print: np.ndarray
    several: np.ndarray
    of_run: np.ndarray


def distinct_anchors(runs: Runs, buckets: int) -> Anchors:
    bucket, prints = bucket_of(runs.hash, buckets), runs.hash & np.uint64((1 << 40) - 1)
    order = np.lexsort((runs.doc, prints, bucket))
    b, p, d = bucket[order], prints[order], runs.doc[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1])] if len(b) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    several = np.zeros(int(new.sum()), bool)
    several[group[1:][~new[1:] & (d[1:] != d[:-1])]] = True
    of_run = np.empty(len(b), np.int64)
    of_run[order] = group
    return Anchors(b[new], p[new], several, of_run)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), a, b


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


# ---- chunks of documents


def _chunks(rest: list[str], chunk_bytes: int) -> Callable:
    """Group documents into rows of about `chunk_bytes`, so that later passes see the same documents together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, sizes, data, others = zip(*held, strict=True)
            ids, others = pa.concat_arrays(ids), pa.concat_arrays(others)
            ends = pa.array([0, len(ids)], pa.int32())
            raw = b"".join(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(raw)], pa.int64()), pa.ListArray.from_arrays(ends, ids),
                 pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()),
                 pa.array([zstandard.compress(raw, 3)], pa.binary()), pa.ListArray.from_arrays(ends, others)],
                names=["chunk", "raw", "ids", "sizes", "data", "rest"])

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string()).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            body = memoryview(texts.buffers()[2] or b"")
            others = pa.StructArray.from_arrays([batch.column(c) for c in rest] or [pa.nulls(len(texts), pa.int8())],
                                                rest or ["_none"])
            at = 0
            while at < len(texts):
                to = int(np.searchsorted(offsets, offsets[at] + max(1, chunk_bytes - size), side="left"))
                to = min(max(to, at + 1), len(texts))
                held.append((batch.column("id").slice(at, to - at), np.diff(offsets[at:to + 1]),
                             bytes(body[offsets[at]:offsets[to]]), others.slice(at, to - at)))
                size += int(offsets[to] - offsets[at])
                at = to
                if size >= chunk_bytes or sum(len(h[0]) for h in held) >= 1 << 16:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return run


@dataclass
class _Chunk:
    number: int
    ids: np.ndarray
    sizes: np.ndarray
    data: np.ndarray


def _read(batch: pa.RecordBatch, i: int) -> _Chunk:
    ids = pc.fill_null(batch.column("ids")[i].values, LAST).to_numpy(zero_copy_only=False)
    sizes = np.frombuffer(batch.column("sizes")[i].as_py(), np.int64)
    raw = batch.column("raw")[i].as_py()
    data = zstandard.decompress(batch.column("data")[i].as_py(), max_output_size=max(1, raw))
    return _Chunk(batch.column("chunk")[i].as_py(), ids, sizes, np.frombuffer(data, np.uint8))


# ---- first digit: the anchor


def _send_anchors(window: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _read(batch, i)
                found = distinct_anchors(find_runs(chunk.data, chunk.sizes, window), buckets)
                rows = [(b, chunk.number, found.print[x:y].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                         np.packbits(found.several[x:y]).tobytes()) for b, x, y in _slices(found.bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(
                        zip(*rows, strict=True) if rows else [[]] * 4,
                        (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    names=["bucket", "chunk", "prints", "several"])

    return run


def _meet_anchors(hot: int) -> Callable:
    """Which anchors of a bucket are in two documents or more, and which in very many chunks."""

    def meet(rows: pa.Table) -> pa.Table:
        parts, marks = [], []
        for p, s in zip(rows.column("prints"), rows.column("several"), strict=True):
            five = np.frombuffer(p.as_py(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            parts.append(wide.view(np.uint64)[:, 0])
            marks.append(np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=len(five)))
        prints, several = np.concatenate(parts), np.concatenate(marks).astype(bool)
        _, place, count = np.unique(prints, return_inverse=True, return_counts=True)
        again = several | (count[place] > 1)
        often = again & (count[place] >= hot)
        cut = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({
            "chunk": rows.column("chunk"), "bucket": rows.column("bucket"),
            "reply": pa.array([np.packbits(a).tobytes() + np.packbits(o).tobytes() for a, o in zip(
                np.split(again, cut), np.split(often, cut), strict=True)], pa.binary())})

    return meet


# ---- the other digits


@dataclass
class Sent:
    """Distinct contexts (an anchor with the bytes on both sides that its windows can reach) or single windows, in the
    order they are sent: bucket, bytes, range of window offsets, least document id; for each run (or window) its
    place among them."""

    bucket: np.ndarray
    bytes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    of: np.ndarray


def _distinct(bucket: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> Sent:
    if not len(rows):
        none = np.empty(0, np.int64)
        return Sent(none, rows, none, none, none, none)
    full = np.ascontiguousarray(np.column_stack([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), rows,
                                                 low.astype(np.uint8), high.astype(np.uint8)]))
    _, first, of = np.unique(full.view(f"V{full.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    least = np.full(len(first), LAST)
    np.minimum.at(least, of, ids)
    return Sent(bucket[first], rows[first], low[first], high[first], least, of)


def survivors(chunk: _Chunk, window: int, buckets: int, replies: list[dict]) -> tuple[Runs, Sent, np.ndarray, Sent, int]:
    """Runs whose anchor repeats, their contexts, and the windows of very frequent anchors one by one (starts, rows)."""
    k = anchor_width(window)
    side = window - k
    runs = find_runs(chunk.data, chunk.sizes, window)
    found = distinct_anchors(runs, buckets)
    again, often = np.zeros(len(found.bucket), bool), np.zeros(len(found.bucket), bool)
    reply_of = {r["bucket"]: r["reply"] for r in replies}
    for b, x, y in _slices(found.bucket):
        bits = np.frombuffer(reply_of[b], np.uint8)
        half = len(bits) // 2
        again[x:y] = np.unpackbits(bits[:half], count=y - x)
        often[x:y] = np.unpackbits(bits[half:], count=y - x)
    live, hot = again[found.of_run] & ~often[found.of_run], often[found.of_run]
    ends = np.cumsum(chunk.sizes)
    begins = ends - chunk.sizes
    kept = Runs(*[getattr(runs, f)[live] for f in ("at", "hash", "first", "last", "doc")])
    place = kept.at[:, None] + np.arange(-side, k + side)
    inside = (place >= begins[kept.doc, None]) & (place < ends[kept.doc, None])
    rows = np.where(inside, chunk.data[np.clip(place, 0, max(0, len(chunk.data) - 1))], np.uint8(0)) if len(
        place) else np.empty((0, k + 2 * side), np.uint8)
    contexts = _distinct(bucket_of(kept.hash, buckets), rows, kept.at - kept.last, kept.at - kept.first,
                         chunk.ids[kept.doc])
    n = (runs.last - runs.first + 1)[hot]
    starts = np.repeat(runs.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    alone = chunk.data[starts[:, None] + np.arange(window)] if len(starts) else np.empty((0, window), np.uint8)
    hashed = np.zeros(len(starts), np.uint64)
    for i in range(0, window, 8):
        piece = np.zeros((len(starts), 8), np.uint8)
        piece[:, :len(range(i, min(i + 8, window)))] = alone[:, i:i + 8]
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + piece.view(np.uint64)[:, 0])
    zero = np.zeros(len(starts), np.int64)
    doc = np.searchsorted(ends, starts, side="right")
    return kept, contexts, starts, _distinct(bucket_of(hashed, buckets), alone, zero, zero, chunk.ids[doc]), k


def _send_windows(window: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _read(batch, i)
                _, contexts, _, alone, _ = survivors(chunk, window, buckets, batch.column("replies")[i].as_py() or [])
                rows = [(b, kind, chunk.number, y - x, _pack(s.bytes[x:y], s.low[x:y].astype(np.uint8),
                                                             s.high[x:y].astype(np.uint8), s.least[x:y]))
                        for kind, s in enumerate((contexts, alone)) for b, x, y in _slices(s.bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(
                        zip(*rows, strict=True) if rows else [[]] * 5,
                        (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["bucket", "kind", "chunk", "n", "sent"])

    return run


def least_of_equals(rows: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id among equal rows of its group. `group` ascends.

    Most-significant-digit passes of 8 bytes: a group whose rows are all equal is done, a group of one row drops out,
    the others are ordered by their next digit and split."""
    least = ids.copy()
    index = np.arange(len(rows))
    for digit in range(0, rows.shape[1] + 8, 8):
        if not len(index):
            break
        new = np.r_[True, group[1:] != group[:-1]]
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        equal = np.logical_and.reduceat((rows[index] == rows[index[starts]][of]).all(1), starts)
        low = np.minimum.reduceat(ids[index], starts)
        done = equal[of]
        least[index[done]] = low[of[done]]
        index, group = index[~done], of[~done]
        if len(index):
            piece = np.zeros((len(index), 8), np.uint8)
            part = rows[index, digit:digit + 8]
            piece[:, :part.shape[1]] = part
            value = piece.view(">u8")[:, 0].astype(np.uint64)
            order = np.lexsort((value, group))
            index, group, value = index[order], group[order], value[order]
            group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) - 1
            size = np.bincount(group)
            many = size[group] > 1
            index, group = index[many], group[many]
    return least


def _meet_windows(window: int) -> Callable:
    """For every sent row, one bit per window offset: some document with a smaller id has the same window."""
    k = anchor_width(window)
    side = window - k

    def meet(rows: pa.Table) -> pa.Table:
        kind, counts = rows.column("kind")[0].as_py(), rows.column("n").to_numpy()
        width = window if kind else k + 2 * side
        total = int(counts.sum())
        wide = np.empty((total, width), np.uint8)
        low, high, ids = np.empty(total, np.uint8), np.empty(total, np.uint8), np.empty(total, np.int64)
        at = 0
        for n, sent in zip(counts.tolist(), rows.column("sent"), strict=True):
            raw = np.frombuffer(zstandard.decompress(sent.as_py(), max_output_size=n * (width + 10)), np.uint8)
            wide[at:at + n] = raw[:n * width].reshape(n, width)
            low[at:at + n], high[at:at + n] = raw[n * width:n * (width + 1)], raw[n * (width + 1):n * (width + 2)]
            ids[at:at + n] = raw[n * (width + 2):].view(np.int64)
            at += n
        mask = np.zeros(total, np.uint32)
        if kind:
            mask[least_of_equals(wide, np.zeros(total, np.int64), ids) < ids] = 1
        else:
            anchor = np.ascontiguousarray(wide[:, side:side + k]).view(f"V{k}")[:, 0]
            order = np.argsort(anchor, kind="stable")
            wide, low, high, ids = wide[order], low[order], high[order], ids[order]
            group = np.cumsum(np.r_[True, (wide[1:, side:side + k] != wide[:-1, side:side + k]).any(1)]) - 1
            found = np.zeros(total, np.uint32)
            for t in range(side + 1):
                some = np.flatnonzero((low <= t) & (t <= high))
                if len(some):
                    least = least_of_equals(wide[some, side - t:side - t + window], group[some], ids[some])
                    found[some[least < ids[some]]] |= np.uint32(1 << t)
            mask[order] = found
        cut = np.cumsum(counts)[:-1]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "kind": rows.column("kind"),
                         "reply": pa.array([_pack(m) for m in np.split(mask, cut)], pa.binary())})

    return meet


# ---- removal


def _mask_of(sent: Sent, kind: int, replies: list[dict]) -> np.ndarray:
    reply_of = {r["bucket"]: r["reply"] for r in replies if r["kind"] == kind}
    mask = np.zeros(len(sent.bucket), np.uint32)
    for b, x, y in _slices(sent.bucket):
        mask[x:y] = np.frombuffer(zstandard.decompress(reply_of[b], max_output_size=4 * (y - x)), np.uint32)
    return mask


def _remove(window: int, buckets: int, rest: list[str], whole: bool) -> Callable:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _read(batch, i)
                runs, contexts, starts, alone, _ = survivors(chunk, window, buckets, batch.column("replies")[i].as_py() or [])
                answers = batch.column("answers")[i].as_py() or []
                change = np.zeros(len(chunk.data) + 1, np.int32)
                later = chunk.ids[runs.doc] > contexts.least[contexts.of]
                np.add.at(change, runs.first[later], 1)
                np.add.at(change, runs.last[later] + window, -1)
                mask = _mask_of(contexts, 0, answers)[contexts.of]
                for t in range(window - anchor_width(window) + 1):
                    hit = runs.at[~later & (mask >> np.uint32(t) & np.uint32(1)).astype(bool)] - t
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + window, -1)
                ends = np.cumsum(chunk.sizes)
                if len(starts):
                    own = chunk.ids[np.searchsorted(ends, starts, side="right")]
                    hit = starts[(own > alone.least[alone.of]) | (_mask_of(alone, 1, answers)[alone.of] > 0)]
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                if whole and gone.any():
                    letter = np.flatnonzero((chunk.data & 0xC0) != 0x80)  # first bytes of UTF-8 characters
                    gone = np.repeat(np.logical_or.reduceat(gone, letter), np.diff(np.append(letter, len(gone))))
                begins = ends - chunk.sizes
                # Spans by document: a removed run ends at the end of its document.
                edge = np.zeros(len(gone) + 1, bool)
                edge[begins] = True
                first = np.flatnonzero(gone & (~np.r_[False, gone[:-1]] | edge[:-1]))
                last = np.flatnonzero(gone & (~np.r_[gone[1:], False] | edge[1:])) + 1
                cut = np.searchsorted(first, np.append(begins, len(gone)))
                doc = np.searchsorted(ends, first, side="right")
                spans = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(first - begins[doc]), pa.array(last - begins[doc])], fields=list(span)))
                left = np.append(0, np.cumsum(np.append(0, np.cumsum(~gone))[ends] - np.append(0, np.cumsum(~gone))[begins]))
                body = chunk.data[~gone].tobytes()
                kept = [body[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                others = batch.column("rest")[i].values
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(chunk.sizes), spans, pa.array(kept, pa.binary()),
                     *(others.field(n) for n in range(len(rest)))],
                    names=["id", "n_bytes", "spans", "kept", *rest])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, id_col: str = "doc_id",
                   text_col: str = "text", hot_chunks: int = HOT_CHUNKS, bucket_bytes: int = BUCKET_BYTES,
                   whole_characters: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, spans (array of start, end in bytes: what is removed), kept (the remaining
    bytes), and the columns `keep`, renamed to c0, c1, ...

    With `whole_characters` a character goes if one of its bytes does, so what is left is text.

    A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller id. The suffixes
    that start at all bytes are ordered through their first `window` bytes only, digit by digit, and leave the sort as
    soon as they are alone. The first digit is the window's anchor, which stands for a run of neighbouring windows, so
    one row per run is sorted; fingerprints of anchors that only one document has end there. The rest are sorted by
    their other bytes, 8 at a time, on the bytes themselves. Equal groups are exactly the repeated windows.

    Documents are held in compressed chunks, and each chunk sends a distinct anchor or context once with its least id,
    so thousands of copies do not add up in one bucket; anchors found in `hot_chunks` chunks or more are dealt out by
    their whole windows instead. Replies are bits. They are joined to the chunks, by broadcast while they are small.

    Defined cases: a null text is empty; texts shorter than `window` keep all; rows that repeat an id do not remove
    each other's bytes; a null id counts as larger than all others; an empty table gives an empty result.
    """
    if not 2 <= window <= 61:
        raise ValueError("windows of 2 to 61 bytes")
    keep = keep or []
    rest = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(r) for c, r in zip(keep, rest, strict=True)])
    kinds = ", ".join(f"{r}: {docs.schema[c].dataType.simpleString()}" for c, r in zip(keep, rest, strict=True))
    chunks = settle(spread(rows, "id").mapInArrow(
        _chunks(rest, chunk_bytes), "chunk bigint, raw bigint, ids array<bigint>, sizes binary, data binary, "
                       f"rest array<struct<{kinds or '_none: tinyint'}>>"))
    total = chunks.agg(F.sum("raw")).first()[0] or 0
    buckets = int(min(1 << 23, max(1, -(-total // bucket_bytes))))
    plain = chunks.select("chunk", "raw", "ids", "sizes", "data")
    prints = plain.mapInArrow(_send_anchors(window, buckets), "bucket bigint, chunk bigint, prints binary, several binary")
    replies = prints.groupBy("bucket").applyInArrow(_meet_anchors(hot_chunks), "chunk bigint, bucket bigint, reply binary")
    replies = settle(replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies")))
    sent = _joined(plain, replies, "replies").mapInArrow(
        _send_windows(window, buckets), "bucket bigint, kind int, chunk bigint, n bigint, sent binary")
    answers = sent.groupBy("bucket", "kind").applyInArrow(
        _meet_windows(window), "chunk bigint, bucket bigint, kind int, reply binary")
    answers = settle(answers.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "kind", "reply")).alias("answers")))
    full = _joined(_joined(chunks, replies, "replies"), answers, "answers")
    out = full.mapInArrow(_remove(window, buckets, rest, whole_characters), "id bigint, n_bytes bigint, spans array<struct<start: bigint, "
                          "end: bigint>>, kept binary" + (", " + kinds.replace(": ", " ") if kinds else ""))
    return out.withColumnRenamed("id", id_col)


def _joined(chunks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Replies are joined by chunk; while they are small they are broadcast, so the texts stay where they are."""
    size = replies.agg(F.sum(F.aggregate(name, F.lit(0), lambda a, r: a + F.length(r["reply"])))).first()[0] or 0
    return chunks.join(F.broadcast(replies) if size <= BROADCAST_BYTES else replies, "chunk", "left")
