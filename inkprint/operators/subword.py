"""Unigram subword vocabulary, fitted with Spark, and its use to encode and decode posts.

The published unigram language model: start from frequent substrings, alternate expectation and maximisation,
drop the pieces that cost the least likelihood, repeat. Spark counts words and substrings, spreads the expectation
step over distinct words and adds up the expected counts; the driver only ever holds the piece table, whose size
is a parameter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkprint.functions.lattice import Pieces, best_cuts, by_length, expected_uses
from inkprint.functions.text import words
from inkprint.session import settle, spread

# Word-start mark and the ids of the reserved pieces.
MARK = "▁"
RESERVED = {"<pad>": 0, "</s>": 1, "<unk>": 2}
UNK_ID = 2

MAX_PIECE_CHARS = 16
SEED_PIECES = 200_000
VECTOR_CHARS = 40
KEEP_FRACTION = 0.5
EM_ROUNDS = 2
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 200_000
ENCODED_TEXTS = 256  # whose new words are cut together
MAX_VOCAB = 1_000_000


def word_counts(lines: DataFrame, body: str) -> DataFrame:
    """Distinct marked words with their frequency; counted on the map side first."""
    marked = F.concat(F.lit(MARK), F.col("word"))
    return lines.select(F.explode(words(F.col(body))).alias("word")).groupBy(marked.alias("word")).agg(
        F.count("*").alias("n"))


def seed_pieces(counts: DataFrame, size: int, max_chars: int = MAX_PIECE_CHARS) -> DataFrame:
    """(piece, n): every character, and the most valuable repeated substrings (frequency times length). A word is first
    opened into windows of `max_chars`, so that long words cost time in proportion to their length."""
    starts = F.sequence(F.lit(1), F.length("word"))
    spans = counts.select("n", F.explode(F.transform(starts, lambda i: F.substring("word", i, F.lit(max_chars)))).alias("w"))
    sizes = F.sequence(F.lit(1), F.length("w"))
    pieces = settle(spans.select(F.explode(F.transform(sizes, lambda k: F.substring("w", F.lit(1), k))).alias("piece"), "n"
                                 ).groupBy("piece").agg(F.sum("n").alias("n")).where((F.length("piece") == 1) | (F.col("n") > 1)))
    characters = pieces.where(F.length("piece") == 1)
    longer = pieces.where(F.length("piece") > 1).orderBy(
        F.desc(F.col("n") * F.length("piece")), "piece").limit(size)
    return characters.unionByName(longer)


def _lattice(word: str, scores: dict[str, float], longest: int, skip: str | None = None):
    """For every end position, the (start, piece, log probability) of the pieces ending there."""
    for end in range(1, len(word) + 1):
        arcs = []
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            if piece in scores and piece != skip:
                arcs.append((start, piece, scores[piece]))
        yield end, arcs


def best_split(word: str, scores: dict[str, float], longest: int, floor: float, skip: str | None = None):
    """Most likely pieces of a word and their log probability; an uncovered character stands for itself at `floor`."""
    best = [0.0] + [-math.inf] * len(word)
    back: list[tuple[int, str | None]] = [(0, None)] * (len(word) + 1)
    for end, arcs in _lattice(word, scores, longest, skip):
        for start, piece, score in arcs:
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, piece)
        if best[end] == -math.inf:
            best[end], back[end] = best[end - 1] + floor, (end - 1, None)
    out, at = [], len(word)
    while at > 0:
        start, piece = back[at]
        out.append(piece)
        at = start
    return out[::-1], best[-1]


def _add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _expected_uses(word: str, chances: dict[str, float], longest: int, uses: dict[str, float], weight: float) -> bool:
    """Add the expected number of uses of every piece over all splits of the word. False, with nothing added, when the
    word is so long that its probability leaves the range of floating-point numbers."""
    size = len(word)
    ahead = [1.0] + [0.0] * size
    arcs = []
    for end in range(1, size + 1):
        total = 0.0
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            chance = chances.get(piece)
            if chance is not None:
                reach = ahead[start] * chance
                total += reach
                arcs.append((start, end, piece, chance))
        ahead[end] = total
    whole = ahead[size]
    if whole < 1e-200:
        return False
    behind = [0.0] * size + [1.0]
    scale = weight / whole
    for start, end, piece, chance in reversed(arcs):
        rest = behind[end] * chance
        behind[start] += rest
        uses[piece] += ahead[start] * rest * scale
    return True


def _expected_uses_log(word: str, scores: dict[str, float], longest: int, uses: dict[str, float], weight: float) -> None:
    """The same in logarithms, for long words."""
    lattice = list(_lattice(word, scores, longest))
    ahead = [0.0] + [-math.inf] * len(word)
    for end, arcs in lattice:
        for start, _, score in arcs:
            ahead[end] = _add(ahead[end], ahead[start] + score)
    whole = ahead[-1]
    if whole == -math.inf:
        return
    behind = [-math.inf] * len(word) + [0.0]
    for end, arcs in reversed(lattice):
        for start, piece, score in arcs:
            behind[start] = _add(behind[start], behind[end] + score)
            uses[piece] += weight * math.exp(ahead[start] + score + behind[end] - whole)


def _expectation(counts: DataFrame, scores: dict[str, float]) -> dict[str, float]:
    """Expected uses of each piece over the whole word table. One partial sum per piece and task is shuffled.

    Words of one length go through the sums together, as arrays; words so long that their probability would leave the
    range of floating-point numbers go one by one, in logarithms."""
    shared = counts.sparkSession.sparkContext.broadcast(scores)
    longest = max(map(len, scores))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = shared.value
        names = list(scores)
        pieces, prob = Pieces(names), np.exp(np.append(list(scores.values()), -np.inf))
        uses, rare = np.zeros(len(names) + 1), defaultdict(float)
        for batch in batches:
            words, n = batch["word"].tolist(), batch["n"].to_numpy(np.float64)
            for group in by_length(words):
                if len(words[group[0]]) <= VECTOR_CHARS:
                    expected_uses(pieces.arcs([words[i] for i in group]), prob, n[group], uses)
                else:
                    for i in group:
                        _expected_uses_log(words[i], scores, longest, rare, float(n[i]))
        found = {p: u for p, u in zip(names, uses) if u > 0}
        for p, u in rare.items():
            found[p] = found.get(p, 0.0) + u
        if found:
            yield pd.DataFrame({"piece": list(found), "uses": list(found.values())})

    summed = counts.mapInPandas(run, "piece string, uses double").groupBy("piece").agg(
        F.round(F.sum("uses"), 6).alias("uses"))
    got = summed.toArrow()
    out = dict(zip(got["piece"].to_pylist(), got["uses"].to_pylist(), strict=True))
    shared.unpersist()
    return out


def _log_probabilities(uses: dict[str, float]) -> dict[str, float]:
    total = math.log(sum(uses.values()))
    return {p: math.log(u) - total for p, u in uses.items()}


def _prune(spark, scores: dict[str, float], uses: dict[str, float], keep: int) -> dict[str, float]:
    """Keep all characters and the `keep` longer pieces whose removal would cost the most likelihood."""
    shared = spark.sparkContext.broadcast(scores)
    longest, floor = max(map(len, scores)), min(scores.values()) - UNKNOWN_PENALTY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            loss = [u * (shared.value[p] - best_split(p, shared.value, longest, floor, skip=p)[1])
                    for p, u in zip(batch["piece"], batch["uses"])]
            yield pd.DataFrame({"piece": batch["piece"], "loss": loss})

    names = [p for p in scores if len(p) > 1]
    longer = spark.createDataFrame(pa.table({"piece": names, "uses": [float(uses.get(p, 0.0)) for p in names]}))
    ranked = longer.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "piece string, loss double")
    kept = set(ranked.orderBy(F.desc("loss"), "piece").limit(keep).toArrow()["piece"].to_pylist())
    shared.unpersist()
    return {p: s for p, s in scores.items() if len(p) == 1 or p in kept}


def fit_subword_vocab(lines: DataFrame, body: str, size: int, max_chars: int = MAX_PIECE_CHARS,
                      seed_size: int = SEED_PIECES) -> DataFrame:
    """(piece, piece_id, score): at most `size` entries, fewer when the text does not support more. Pieces have at most
    `max_chars` characters; the fit starts from the `seed_size` most valuable substrings, or four times `size`."""
    spark = lines.sparkSession
    counts = settle(word_counts(lines, body).repartition(spark.sparkContext.defaultParallelism, "word"))
    work = spread(counts, "word")
    found = seed_pieces(counts, max(seed_size, 4 * size), max_chars).toArrow()
    seeds = {p: float(n) for p, n in zip(found["piece"].to_pylist(), found["n"].to_pylist(), strict=True)}
    scores = _log_probabilities(seeds)
    room = size - len(RESERVED) - sum(len(p) == 1 for p in scores)
    if room < 0:
        raise ValueError(f"{size} entries cannot hold all characters of the text")
    while True:
        for _ in range(EM_ROUNDS):
            uses = _expectation(work, scores)
            # Unlikely longer pieces go at once; characters stay, so that every word keeps a split.
            alive = {p: max(uses.get(p, 0.0), 1e-6) for p in scores if len(p) == 1 or uses.get(p, 0.0) >= 0.5}
            scores = _log_probabilities(alive)
        longer = sum(len(p) > 1 for p in scores)
        if longer <= room:
            break
        scores = _prune(spark, scores, uses, max(room, int(longer * KEEP_FRACTION)))
    ordered = sorted(scores.items(), key=lambda item: (-item[1], item[0]))
    rows = [(p, i, 0.0) for p, i in RESERVED.items()]
    rows += [(p, i + len(RESERVED), s) for i, (p, s) in enumerate(ordered)]
    return spark.createDataFrame(rows, "piece string, piece_id int, score double")


def encode_posts(posts: DataFrame, vocab: DataFrame, body: str, max_symbols: int | None = None,
                 name: str = "syms") -> DataFrame:
    """Add the piece ids of every post. The vocabulary has a fixed maximum size and travels as a broadcast; posts are
    not shuffled, and each task splits a repeated word once."""
    rows = vocab.limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCAB} pieces")
    table = {r["piece"]: (r["piece_id"], r["score"]) for r in rows}
    scores = {p: s for p, (i, s) in table.items() if p not in RESERVED}
    ids = {p: i for p, (i, s) in table.items()}
    shared = posts.sparkSession.sparkContext.broadcast((scores, ids))
    longest, floor = max(map(len, scores)), min(scores.values()) - UNKNOWN_PENALTY

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores, ids = shared.value
        names = list(scores)
        pieces, chances = Pieces(names), np.append(list(scores.values()), -np.inf)
        numbers = [*(ids[p] for p in names), UNK_ID]
        known: dict[str, list[int]] = {}

        def keep(word: str, found: list[int]) -> None:
            known[word] = [i for i, before in zip(found, [None, *found]) if not i == before == UNK_ID]

        def learn(words: list[str]) -> None:
            for group in by_length(words):
                marked = [MARK + words[i] for i in group]
                if len(marked[0]) <= VECTOR_CHARS:
                    for i, cut in zip(group, best_cuts(pieces.arcs(marked), chances, floor)):
                        keep(words[i], [numbers[p] for p in cut])
                else:
                    for i, word in zip(group, marked):
                        keep(words[i], [UNK_ID if p is None else ids[p] for p in best_split(word, scores, longest, floor)[0]])

        def texts(part: pd.Series) -> list[list[int]]:
            if len(known) >= CACHED_WORDS:
                known.clear()
            learn(list({w for ws in part if ws is not None for w in ws}.difference(known)))
            return [[] if ws is None else [i for w in ws for i in known[w]] for ws in part]

        for batch in batches:
            parts = [texts(batch.iloc[i:i + ENCODED_TEXTS]) for i in range(0, len(batch), ENCODED_TEXTS)]
            yield pd.Series([x for part in parts for x in part], index=batch.index, dtype=object)

    symbols: Column = encode(words(F.col(body)))
    return posts.withColumn(name, symbols if max_symbols is None else F.slice(symbols, 1, max_symbols))


def decode_posts(encoded: DataFrame, vocab: DataFrame, key: str, syms: str = "syms") -> DataFrame:
    """(key, text): pieces joined in order, word marks turned into spaces; ids without a piece are left out. The pieces,
    a table of bounded size, are looked up where the ids are, so nothing is shuffled."""
    rows = vocab.select("piece_id", "piece").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCAB} pieces")
    shared = encoded.sparkSession.sparkContext.broadcast({r["piece_id"]: r["piece"] for r in rows})

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = shared.value
        for batch in batches:
            yield batch.map(lambda ids: "" if ids is None else "".join(pieces.get(i, "") for i in ids)).astype(object)

    joined = decode(F.col(syms))
    return encoded.select(key, F.ltrim(F.replace(joined, F.lit(MARK), F.lit(" "))).alias("text"))


def concat_posts(posts: DataFrame, keys: list[str], order: str, body: str = "text") -> DataFrame:
    """Texts of an episode, each followed by a newline. Episodes have a fixed maximum length."""
    items = F.sort_array(F.collect_list(F.struct(order, body)))
    joined = posts.groupBy(*keys).agg(items.alias("i"))
    return joined.select(*keys, F.concat(F.array_join(F.col(f"i.{body}"), "\n"), F.lit("\n")).alias("text"))
