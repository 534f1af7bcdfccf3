"""Phrase collocations: best-first growth of phrases from their first words, bounded by counts of prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.llm.common import mix
from inkprint.session import broadcast_if_small, settle, spread

NO_LANGUAGE = "und"
LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 25  # of a filter: 4 MB, whatever the number of phrases
BUCKET = 15  # bits of a position inside one row of a filter
CHUNK_BYTES = 1 << 24
SALTS = 64
MOST_LANGUAGES = 100_000
BREAK = b"."
ROLES = ("grow", "want", "path", "often")  # phrases to continue, to count, their beginnings, frequent words
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9)


# Counting inside tasks.

def _numbered(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in the order they appear, and the texts as places in that list. Word 0 is a break, which stands
    before, between and after all pieces."""
    data = b" . ".join([b"", *(t.encode() for t in texts), b""]).translate(_MAP).replace(BREAK, b" . ")
    found = data.split()
    first_place = {BREAK: 0}
    ids = np.fromiter(map(first_place.setdefault, found, count(1)), np.int32, len(found))
    number = np.zeros(len(found) + 1, np.int32)
    number[np.fromiter(first_place.values(), np.int64, len(first_place))] = np.arange(len(first_place))
    return list(first_place), number[ids]


class Words:
    """Numbered words of some texts."""

    def __init__(self, names: pa.Array, ids: np.ndarray) -> None:
        self.names, self.ids = names, ids
        self.codes = np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.uint64, len(names))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of `size` words at some places."""
        return pc.binary_join_element_wise(*[self.names.take(pa.array(self.ids[at + j])) for j in range(size)], " ")

    def _keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Equal numbers for equal phrases of `size` words."""
        base = len(self.names)
        key, top = self.ids[at].astype(np.int64), base
        for j in range(1, size):
            if top * base >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                top = len(at)
            key = key * base + self.ids[at + j]
            top *= base
        return key

    def distinct(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct phrase among those at some places, and its number."""
        _, first, number = np.unique(self._keys(at, size), return_index=True, return_counts=True)
        return at[first], number

    def beside(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As `distinct`, with the one word before and after all places of a phrase: 0 where there are several or a
        break."""
        if not len(at):
            return at, at, at, at
        key = self._keys(at, size)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
        sole = []
        for ids in (self.ids[at - 1][order], self.ids[at + size][order]):
            least, most = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
            sole.append(np.where(least == most, least, 0))
        return at[order[start]], np.diff(start, append=len(at)), *sole


def _language_code(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode())], np.uint64))[0]


def _code_of(lang: str, phrase: str) -> int:
    """Place of a phrase in a filter."""
    h = np.array([_language_code(lang)])
    for word in phrase.encode().split(b" "):
        h = mix(h + np.uint64(zlib.crc32(word)))
    return int(h[0] >> np.uint64(64 - BITS))


def _in(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    place = code >> np.uint64(64 - BITS)
    return bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1


CHUNK = "lang string, words array<string>, ids binary"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one language at a time, about `CHUNK_BYTES` letters or one text."""
    held: dict[str, list[str]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            words, ids = _numbered(held.pop(lang))
            names = pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), names, pa.array([ids.tobytes()], pa.binary())],
                                             names=["lang", "words", "ids"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                held.setdefault(lang, []).append(text.as_py())
                size += len(held[lang][-1]) + 16
                if size > CHUNK_BYTES:
                    yield from rows()
                    size = 0
    yield from rows()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        for lang, words, ids in zip(*batch.columns):
            yield lang.as_py(), Words(words.values, np.frombuffer(ids.as_buffer(), np.int32))


_WORD_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, some in _chunks(batches):
        number = np.bincount(some.ids, minlength=len(some.names))
        number[0] = number[1:].sum()  # without a phrase: all words
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(number)),
             pa.concat_arrays([pa.nulls(1, pa.string()), some.names.slice(1)]), pa.array(number, pa.int64())], schema=_WORD_ROWS)


FIELDS = "lang string, phrase string, side string, beside string, n bigint"
_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("side", pa.string()), ("beside", pa.string()),
                   ("n", pa.int64())])


def _count_phrases(filters: Broadcast, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow, want, path, often = (filters.value[k] for k in ROLES)

        def rows(lang: str, some: Words, first: np.ndarray, size: int, number: np.ndarray, side: str | None = None,
                 beside: np.ndarray | None = None) -> pa.RecordBatch:
            n = len(first)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), n), some.phrases(first, size), pa.repeat(pa.scalar(side, pa.string()), n),
                 pa.nulls(n, pa.string()) if beside is None else some.names.take(pa.array(beside)), pa.array(number, pa.int64())],
                schema=_ROWS)

        for lang, some in _chunks(batches):
            code = mix(_language_code(lang) + some.codes)
            usual, grown = _in(often, code), _in(grow, code)
            usual[0] = grown[0] = False
            at = np.flatnonzero((grown | usual & _in(path, code))[some.ids])
            code, grows = code[some.ids[at]], grown[some.ids[at]]
            for size in range(2, longest + 1):
                going = usual[some.ids[at + size - 1]]  # all words are frequent, and in one piece
                at, grows = at[going], grows[going]
                code = mix(code[going] + some.codes[some.ids[at + size - 1]])
                first, number = some.distinct(at[grows | _in(want, code)], size)
                yield rows(lang, some, first, size, number)
                if size == longest:
                    break
                grows = _in(grow, code)
                first, number, *sole = some.beside(at[grows], size)
                for side, beside in zip(("before", "after"), sole):
                    one = beside > 0
                    yield rows(lang, some, first[one], size, number[one], side, beside[one])
                on = grows | _in(path, code)
                at, code, grows = at[on], code[on], grows[on]

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_code_of(lang, p) for lang, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["role", "place"])


def _filters(rows: DataFrame) -> dict[str, np.ndarray]:
    """One filter per role of (role, lang, phrase): bits set at the places of its phrases. At most 2^(BITS - BUCKET) rows
    of 4 KB a role come back, however many phrases there are; a full filter would only let more phrases be counted."""
    places = rows.mapInArrow(_places, "role string, place bigint")
    parts = places.groupBy("role", F.shiftright("place", BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << BUCKET) - 1)).alias("bits")).collect()
    out = {role: np.zeros(1 << (BITS - 3), np.uint8) for role in ROLES}
    for role, bucket, bits in parts:
        at = bucket << (BUCKET - 3)
        out[role][at:at + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


# Growth.

def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    parts = F.struct((_wide(1000 * a) * _wide(n)).alias("x"), (_wide(left) * _wide(right)).alias("y"))
    return F.transform(F.array(parts), lambda p: F.call_function("div", p["x"], p["y"]))[0]


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, with their `rank`; shares of a language are cut before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    short = rows.withColumn("_place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)))
    short = short.where(F.col("_place") <= top)
    return short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top).drop("_place")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Search:
    """What is known so far, as settled tables.

    Nodes are phrases with their number `a`, those of their prefixes (`lefts`), of their first word and of all words of
    the language. A cut's score is 1000 a n / (l r) with a <= r, so no phrase that begins like a node scores above
    1000 n / l for any of its prefixes; the first word, the most frequent prefix, gives the least bound.
    """

    def __init__(self, texts: DataFrame, least: int, longest: int, top: int) -> None:
        self.least, self.longest, self.top, self.spark = least, longest, top, texts.sparkSession
        self.texts = settle(texts.mapInArrow(_number, CHUNK), "zstd")
        counted = settle(self.texts.mapInArrow(_count_words, "lang string, phrase string, n bigint").groupBy("lang", "phrase")
                         .agg(F.sum("n").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= least)))
        totals = broadcast_if_small(counted.where("phrase is null").select("lang", F.col("a").alias("n")), MOST_LANGUAGES)
        words = counted.where("phrase is not null").join(totals, "lang").withColumn("level", F.floor(F.log2("a")))
        mass = words.groupBy("lang", "level").agg(F.sum("a").alias("mass"), F.first("n").alias("n"))
        rising = Window.partitionBy("lang").orderBy("level")
        early = mass.select("lang", "level", ((F.sum("mass").over(rising) * 2 <= F.col("n"))
                                              | (F.row_number().over(rising) == 1)).alias("early"))
        words = words.join(broadcast_if_small(early, MOST_LANGUAGES), ["lang", "level"])
        self.nodes = settle(words.select("lang", "phrase", F.lit(1).alias("k"), "a", "n", F.col("a").alias("first"),
                                         F.array().cast("array<bigint>").alias("lefts"), "early"))
        #: counted phrases; nodes whose cuts are all scored; nodes with a cut to score; phrases with a sole neighbour
        self.counts = [self.nodes.select("lang", "phrase", "a")]
        self.scored: list[DataFrame] = []
        self.pending: DataFrame | None = None
        self.seen: list[DataFrame] = []

    def survivors(self) -> DataFrame | None:
        """Scored phrases that no longer candidate of equal number holds: the longest, and those seen beside several
        words, or a break, on both sides."""
        if not self.scored:
            return None
        rows = _union(self.scored)
        whole = rows.where(F.col("k") == self.longest)
        if self.seen:
            whole = whole.unionByName(rows.join(_union(self.seen).where("not inside"), ["lang", "phrase"], "left_semi"))
        return whole

    def threshold(self) -> DataFrame | None:
        """(lang, least score that can still matter), for languages with enough survivors."""
        rows = self.survivors()
        if rows is None or not self.seen:
            return None
        return broadcast_if_small(settle(_best(rows.select("lang", "phrase", "a", "score"), self.top).where(
            F.col("rank") == self.top).select("lang", F.col("score").alias("least"))), MOST_LANGUAGES)

    def score(self, fresh: DataFrame | None) -> None:
        """Score the cuts of new nodes and of pending ones whose second parts have been counted meanwhile."""
        rows = [r for r in (fresh, self.pending) if r is not None]
        if not rows:
            return
        same = ["lang", "phrase", "k", "a", "n", "first"]
        cuts = _union([r.select(*same, "lefts") for r in rows]).select(*same, F.posexplode("lefts").alias("j", "l"))
        cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', j + 1 - k)"))
        known = _union(self.counts).select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
        cuts = cuts.join(known, ["lang", "rest"], "left").withColumn(
            "cut", F.when(F.col("r").isNotNull(), F.struct(
                _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "j", "l", "r")))
        done = settle(cuts.groupBy(*same).agg(
            F.min("cut").alias("cut"), F.array_compact(F.collect_list(F.when(F.col("r").isNull(), F.col("rest")))).alias("missing"),
            F.transform(F.array_sort(F.collect_list(F.struct("j", "l"))), lambda x: x["l"]).alias("lefts")))
        self.scored.append(done.where(F.size("missing") == 0).select(*same, "cut.l", "cut.r", "cut.score"))
        self.pending = done.where(F.size("missing") > 0).select(*same, "lefts", "missing", F.col("cut.score").alias("most"))

    def wave(self, open_: DataFrame, late: bool) -> DataFrame | None:
        """One reading of the texts: grow the open nodes whose bound reaches the threshold and count what pending
        scores lack. Returns the nodes not grown, or None if nothing was left to do."""
        least = self.threshold()

        def reaching(rows: DataFrame, bound: Column) -> DataFrame:
            if least is None:
                return rows
            return rows.join(least, "lang", "left").where(F.col("least").isNull() | (bound >= F.col("least"))).drop("least")

        may = reaching(open_, F.floor(1000 * F.col("n").cast("decimal(19,0)") / F.col("first")))
        grow = settle(may if late else may.where(F.col("early")))
        tasks = grow.select(F.lit("grow").alias("role"), "lang", "phrase")
        if self.pending is not None:
            wanted = reaching(self.pending, F.col("most")).select("lang", F.explode("missing").alias("phrase")).distinct()
            tasks = tasks.unionByName(wanted.select(F.lit("want").alias("role"), "lang", "phrase"))
        tasks = settle(tasks)
        if tasks.isEmpty():
            return None
        often = self.nodes.select(F.lit("often").alias("role"), "lang", "phrase")
        begins = F.expr("transform(sequence(1, size(split(phrase, ' ')) - 1), k -> substring_index(phrase, ' ', k))")
        path = tasks.where("contains(phrase, ' ')").select(F.lit("path").alias("role"), "lang", F.explode(begins).alias("phrase"))
        filters = self.spark.sparkContext.broadcast(_filters(_union([tasks, often, path.distinct()])))
        found = settle(self.texts.mapInArrow(_count_phrases(filters, self.longest), FIELDS).groupBy(
            "lang", "phrase", "side", "beside").agg(F.sum("n").alias("_a")).where(F.col("_a") >= self.least))
        filters.unpersist()
        counted = found.where("side is null").select("lang", "phrase", "_a")
        parent = F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
        above = grow.select("lang", F.col("phrase").alias("_parent"), "k", "a", "n", "first", "lefts")
        fresh = settle(counted.withColumn("_parent", parent).join(above, ["lang", "_parent"]).select(
            "lang", "phrase", (F.col("k") + 1).alias("k"), F.col("_a").alias("a"), "n", "first",
            F.concat("lefts", F.array("a")).alias("lefts"), F.lit(True).alias("early")))
        wanted = counted.join(tasks.where("role = 'want'"), ["lang", "phrase"], "left_semi").join(
            fresh, ["lang", "phrase"], "left_anti")
        self.counts += [fresh.select("lang", "phrase", "a"), settle(wanted.select("lang", "phrase", F.col("_a").alias("a")))]
        beside = found.where("side is not null").select("lang", "phrase", "_a")
        self.seen.append(settle(grow.where("k > 1").join(beside, ["lang", "phrase"], "left").groupBy("lang", "phrase").agg(
            F.coalesce(F.max(F.col("_a") == F.col("a")), F.lit(False)).alias("inside"))))
        self.score(fresh)
        left = open_.join(grow, ["lang", "phrase"], "left_anti")
        return settle(left.unionByName(fresh.where(F.col("k") < self.longest)))


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST,
         top: int = TOP) -> DataFrame:
    """The `top` phrases of each language by their least score over all cuts: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and separated by blanks within pieces between . , ; : ! ? and line ends. A candidate
    has 2 to `longest` words and a >= `least` occurrences. Cut into two parts that occur l and r times among n words it
    scores floor(1000 a n / (l r)); the lowest cut counts, the shortest first part at ties. A candidate inside a longer
    one with as many occurrences is left out.

    Phrases grow word by word from their first word, best bounds first: the rarest words, half of all occurrences, in
    the first reading of the texts; what they grow to in the next ones; then the frequent words whose bound still
    reaches the score of the language's last place. The texts are numbered word by word once; each reading counts, in one shuffle, the
    continuations of the nodes it grows, words that alone stand beside them, and second parts that scores lack. Filters of fixed size tell tasks what to count;
    they may pass too much, never too little. It ends when no open node and no open score reaches the last place.

    Defined cases: a null language is `und`; a null or empty text has no words; repeated rows count each time; ties are
    broken by number, then phrase; languages without candidates have no rows; an empty table gives none; other columns
    are ignored; a very long text is read whole by one task.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col(text_col).alias("text"))
    search = _Search(spread(rows), least, longest, top)
    open_, step = search.nodes, 0
    while True:
        step += 1
        left = search.wave(open_, late=step > 2)
        if left is None and step <= 2:
            step, left = 2, open_
        if left is None:
            break
        open_ = left
    found = search.survivors()
    if found is None:
        found = search.nodes.select("lang", "phrase", "k", "a", "n", "first", F.col("a").alias("l"), F.col("a").alias("r"),
                                    F.col("a").alias("score")).limit(0)
    return _best(found, top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
