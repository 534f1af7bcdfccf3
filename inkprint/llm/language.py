"""Language identification by unigram piece models that sum over all segmentations of a word."""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprint.llm.common import BASE, mix
from inkprint.session import settle, spread

FIT_DOCS = 2_000
FIT_WORDS = 200_000
ROUNDS = 3
SIDE_BY_SIDE = 24  # letters of words whose sums are plain products; longer runs are summed in logarithms
BLOCK_LETTERS = 1 << 14
FIT_LETTERS = 1 << 16  # of a run of letters that is learnt from
LONGEST = 16  # letters in a piece
PRIOR = 0.1  # pseudo-count of every piece
CACHE_WORDS = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN_LANGUAGE = "und"
MARK = "▁"


def parts_of(text: str) -> list[str]:
    """Lower-cased runs of letters behind a word mark."""
    return [MARK + word for word in _LETTERS.findall(text.lower())]


class Pieces:
    """Piece numbers by a 64-bit hash of their letters, looked up for whole arrays of substrings at once."""

    BITS = 20

    def __init__(self, names: list[str]) -> None:
        self.names, self.none, self.unknown = names, len(names) + 1, len(names)
        self.keys, self.ids = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        for i, name in enumerate(names):
            key = self._key(functools.reduce(self._add, map(np.uint64, map(ord, name)), np.zeros(1, np.uint64)), len(name))
            slot = int(key[0] >> np.uint64(64 - self.BITS))
            while self.ids[slot] >= 0:
                slot = (slot + 1) % len(self.ids)
            self.keys[slot], self.ids[slot] = key[0], i

    @staticmethod
    def _add(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return h * np.uint64(BASE) + (letter + np.uint64(1))

    @staticmethod
    def _key(h: np.ndarray, length: int) -> np.ndarray:
        return mix(h + np.uint64(length * 0xC2B2AE3D27D4EB4F % (1 << 64)))

    def find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), self.none, np.int32)
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == key[left])
            out[left[hit]] = ids[hit]
            on = (ids >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) % len(self.ids)
        return out


@dataclass
class Model:
    """Pieces and their probabilities [language, piece]; the last two columns are for a letter outside the vocabulary
    and for no piece (probability 0)."""

    languages: list[str]
    pieces: Pieces
    prob: np.ndarray

    def arcs(self, words: list[str]) -> np.ndarray:
        """[word, start, length - 1]: the piece there, if any. All words have one length."""
        n = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
        widest = min(n, LONGEST)
        ids = np.full((n, widest, len(words)), self.pieces.none, np.int32)
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, min(widest, n - start) + 1):
                h = Pieces._add(h, letters[:, start + k - 1])
                ids[start, k - 1] = self.pieces.find(Pieces._key(h, k))
        alone = ids[:, 0]
        alone[alone == self.pieces.none] = self.pieces.unknown
        return ids

    def _weights(self, ids: np.ndarray, start: int, k: int) -> np.ndarray | None:
        """[language, word]: probability of the piece of k letters at a place; none if no word has one."""
        found = ids[start, k - 1]
        return None if found.min() == self.pieces.none else self.prob[:, found]

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """[position, language, word]: probability of everything before the position, over all segmentations."""
        n, widest, words = ids.shape
        total = np.zeros((n + 1, len(self.languages), words))
        total[0] = 1
        for end in range(1, n + 1):
            for k in range(1, min(end, widest) + 1):
                weights = self._weights(ids, end - k, k)
                if weights is not None:
                    total[end] += total[end - k] * weights
        return total

    def backward(self, ids: np.ndarray) -> np.ndarray:
        n, widest, words = ids.shape
        total = np.zeros((n + 1, len(self.languages), words))
        total[n] = 1
        for start in range(n - 1, -1, -1):
            for k in range(1, min(n - start, widest) + 1):
                weights = self._weights(ids, start, k)
                if weights is not None:
                    total[start] += total[start + k] * weights
        return total

    def log_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: log of the probability of a word, summed over all its segmentations."""
        out = np.empty((len(words), len(self.languages)))
        for at in _by_length([w if len(w) <= SIDE_BY_SIDE else "" for w in words]):
            if words[at[0]] and len(words[at[0]]) <= SIDE_BY_SIDE:
                out[at] = np.log(self.forward(self.arcs([words[i] for i in at]))[-1]).T
        for i, word in enumerate(words):
            if len(word) > SIDE_BY_SIDE:
                out[i] = self._log_score(word)
        return out

    def _log_score(self, word: str) -> np.ndarray:
        """The same for one run of any length: logarithms of the sums before the last `LONGEST` places are carried from
        block to block."""
        prob = self.log_prob()
        back = np.full((LONGEST, len(self.languages)), -np.inf)  # back[-k]: what ends k letters ago
        back[-1] = 0
        for at in range(0, len(word), BLOCK_LETTERS):
            seen = min(at, LONGEST - 1)
            ids = self.arcs([word[at - seen:at + BLOCK_LETTERS]])[:, :, 0]
            for end in range(seen + 1, len(ids) + 1):
                k = np.arange(1, min(end, ids.shape[1]) + 1)
                sums = back[-k] + prob[:, ids[end - k, k - 1]].T
                top = sums.max(0)
                back[:-1] = back[1:]
                back[-1] = top + np.log(np.exp(sums - top).sum(0))
        return back[-1]

    def log_prob(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.prob)

    def expected_uses(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """[language, piece]: how often each piece is expected in words that count `weight` [language, word] times."""
        uses = np.zeros(self.prob.shape)
        for at in _by_length([w if len(w) <= SIDE_BY_SIDE else "" for w in words]):
            if words[at[0]] and len(words[at[0]]) <= SIDE_BY_SIDE:
                self._add_uses(uses, self.arcs([words[i] for i in at]), weight[:, at])
        for i, word in enumerate(words):
            if len(word) > SIDE_BY_SIDE:
                self._add_long(uses, word, weight[:, i])
        return uses

    def _add_uses(self, uses: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> None:
        before, after = self.forward(ids), self.backward(ids)
        share = weight / before[-1]
        for start in range(ids.shape[0]):
            for k in range(1, min(ids.shape[0] - start, ids.shape[1]) + 1):
                arc = ids[start, k - 1]
                if arc.min() == self.pieces.none:
                    continue
                gain = before[start] * self.prob[:, arc] * after[start + k] * share
                for lang in range(len(self.languages)):
                    uses[lang] += np.bincount(arc, gain[lang], uses.shape[1])

    def _add_long(self, uses: np.ndarray, word: str, weight: np.ndarray) -> None:
        prob, ids = self.log_prob(), self.arcs([word])[:, :, 0]
        n = len(word)
        before, after = np.full((n + 1, len(weight)), -np.inf), np.full((n + 1, len(weight)), -np.inf)
        before[0] = after[n] = 0
        for end in range(1, n + 1):
            k = np.arange(1, min(end, LONGEST) + 1)
            before[end] = np.logaddexp.reduce(before[end - k] + prob[:, ids[end - k, k - 1]].T, axis=0)
        for start in range(n - 1, -1, -1):
            k = np.arange(1, min(n - start, LONGEST) + 1)
            after[start] = np.logaddexp.reduce(after[start + k] + prob[:, ids[start, k - 1]].T, axis=0)
        for k in range(1, min(n, LONGEST) + 1):
            arc = ids[:n - k + 1, k - 1]
            gain = np.exp(before[:n - k + 1].T + prob[:, arc] + after[k:].T - before[n][:, None]) * weight[:, None]
            for lang in range(len(weight)):
                uses[lang] += np.bincount(arc, gain[lang], uses.shape[1])


def _by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for group in groups.values():
        for at in range(0, len(group), most):
            yield group[at:at + most]


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters of a public vocabulary, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    ok = (p for p in names if p == MARK or (p.removeprefix(MARK).isalpha() and len(p) <= LONGEST))
    return list(dict.fromkeys(ok))


def _start(languages: list[str], pieces: list[str]) -> Model:
    size = len(pieces) + 2
    model = Model(languages, Pieces(pieces), np.full((len(languages), size), 1.0 / size))
    model.prob[:, -1] = 0
    return model


def _again(model: Model, uses: np.ndarray) -> Model:
    """The model that gives every piece its share of the expected uses."""
    uses = uses + PRIOR
    uses[:, -1] = 0
    return Model(model.languages, model.pieces, uses / uses.sum(1, keepdims=True))


def _uses(model: Model, counts: list[tuple[str, str, int]]) -> np.ndarray:
    """Expected uses over (language, word, count)."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    place = {w: i for i, w in enumerate(dict.fromkeys(c[1] for c in counts))}
    weight = np.zeros((len(number), len(place)))
    for lang, word, n in counts:
        weight[number[lang], place[word]] += n
    return model.expected_uses(list(place), weight)


def learn(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from (language, word, count), by expectation over all segmentations."""
    model = _start(sorted({c[0] for c in counts}), pieces)
    for _ in range(rounds if counts else 0):
        model = _again(model, _uses(model, counts))
    return model


def _expect(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(model.value.prob.shape)
        for batch in batches:
            uses += _uses(model.value, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        lang, piece = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[lang, piece])],
                                         names=["lang", "piece", "uses"])

    return run


def fit(docs: DataFrame, pieces_path: str, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS, rounds: int = ROUNDS) -> Model:
    """Learn from documents (text, lang), rows with a null in either left out.

    Bounded sample: about `fit_docs` documents of each language, chosen by a hash of the text, and of their words the
    most frequent, `fit_words` over all languages together, none longer than `FIT_LETTERS`. The words stay in a settled
    table; in each round tasks sum the expected uses of pieces over their words, and only the probabilities, one per
    language and piece, come to the driver.
    """
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return learn([], vocabulary(pieces_path))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(w for w in parts_of(text) if len(w) <= FIT_LETTERS)
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # over the sample's words only
    best = words.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= max(1, fit_words // len(sizes)))
    context = docs.sparkSession.sparkContext
    best = settle(best.select("lang", "word", "n").repartition(context.defaultParallelism, "word"))
    model = _start(sorted(sizes), vocabulary(pieces_path))
    for _ in range(rounds):
        shared = context.broadcast(model)
        found = best.mapInArrow(_expect(shared), "lang int, piece int, uses double").groupBy("lang", "piece").agg(
            F.sum("uses").alias("uses")).toArrow()
        shared.unpersist()
        uses = np.zeros(model.prob.shape)
        uses[found.column("lang").to_numpy(), found.column("piece").to_numpy()] = found.column("uses").to_numpy()
        model = _again(model, uses)
    return model


class _Scorer:
    """Log scores of tokens between white space (the sum over their runs of letters) and whether they have a letter, in
    a table of bounded size per worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.table = np.zeros((max(1 << 12, min(CACHE_WORDS, (1 << 22) // max(1, len(model.languages)))),
                               len(model.languages) + 1))

    def _score(self, tokens: list[str]) -> np.ndarray:
        runs = [parts_of(t) for t in tokens]
        distinct = {r: i for i, r in enumerate(dict.fromkeys(r for own in runs for r in own))}
        out = np.zeros((len(tokens), self.table.shape[1]))
        if distinct:
            scores = self.model.log_scores(list(distinct))
            token = np.repeat(np.arange(len(tokens)), [len(own) for own in runs])
            np.add.at(out[:, :-1], token, scores[[distinct[r] for own in runs for r in own]])
            out[token, -1] = 1
        return out

    def rows(self, tokens: list[str]) -> np.ndarray:
        """[token, language + 1] of the listed tokens, which may repeat."""
        new = list({t for t in tokens if t not in self.place})
        if len(self.place) + len(new) > len(self.table):
            self.place.clear()
            new = list(dict.fromkeys(tokens))
        if len(new) > len(self.table):
            own = {t: i for i, t in enumerate(new)}
            return self._score(new)[np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))]
        if new:
            before = len(self.place)
            self.place.update(zip(new, range(before, before + len(new)), strict=True))
            self.table[before:before + len(new)] = self._score(new)
        return self.table[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))]


def _sums(texts: Iterator[str | None], scorer: _Scorer, most: int = 1 << 17) -> np.ndarray:
    """[text, language + 1]: the sums over all tokens; texts are read in blocks of tokens."""
    held, owner = [], []

    def flush() -> None:
        if held:
            np.add.at(total, np.repeat([o for o, _ in owner], [n for _, n in owner]), scorer.rows(held))
        held.clear()
        owner.clear()

    texts = list(texts)
    total = np.zeros((len(texts), len(scorer.model.languages) + 1))
    for i, text in enumerate(texts):
        tokens = (text or "").lower().split()
        for at in range(0, len(tokens), most):
            part = tokens[at:at + most]
            held += part
            owner.append((i, len(part)))
            if len(held) >= most:
                flush()
    flush()
    return total


_SCORERS: dict[str, _Scorer] = {}


def _predict(model: Model, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:  # one per worker and model
            _SCORERS.clear()
            _SCORERS[name] = _Scorer(model)
        scorer = _SCORERS[name]
        for batch in batches:
            lang: list[str] = []
            score: list[float] = []
            for at in range(0, batch.num_rows, 256):
                sums = _sums((t.as_py() for t in batch.column(0).slice(at, 256)), scorer)
                some, sums = sums[:, -1] > 0, sums[:, :-1]
                if not model.languages:
                    lang += [UNKNOWN_LANGUAGE] * len(sums)
                    score += [0.0] * len(sums)
                    continue
                best = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                lang += [model.languages[b] if s else UNKNOWN_LANGUAGE for b, s in zip(best, some, strict=True)]
                score += [float(p) if s else 0.0 for p, s in zip(share, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every document with `lang_pred` and `score`, the probability of that language.

    Each text is lower-cased and read whole. The score of a word under a language is the sum of the probabilities of all
    ways to cut it into vocabulary pieces (forward algorithm), however long it is; words are independent, languages
    equally likely at first.

    Defined cases: a null text or one without a letter is `und` with score 0, as is everything under a model without
    languages; ties go to the language first by code point; letters outside the vocabulary count as one rare piece;
    repeated rows and nulls in other columns pass through.
    """
    place = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(p) for c, p in zip(keep, place, strict=True)])
    kinds = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(keep, place, strict=True))
    scored = spread(rows, *place[:1]).mapInArrow(
        _predict(model, uuid.uuid4().hex), f"{kinds + ', ' if kinds else ''}lang_pred string, score double")
    return scored.select(*[F.col(p).alias(c) for c, p in zip(keep, place, strict=True)], "lang_pred", "score")


def remainder(column: Column, n: int) -> Column:
    """crc32 of an id as text modulo n; null for a null id."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(n))
