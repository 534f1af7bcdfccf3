"""Byte-pair encoding and decoding by dynamic programming over the prefixes of a word."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from inkprint.llm.automaton import SuffixAutomaton
from inkprint.session import spread

WORD_END = "</w>"
CACHE_LETTERS = 1 << 23
PAIRS = 1 << 20
SHIFT = 9  # bits of a symbol
PAIR_SHIFT = 24  # bits of a token id
SIDE_BY_SIDE = 64
CHUNK_LETTERS = 1 << 23
LAST = 256  # added to the byte that ends a word
NEVER = 1 << 60


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes follow from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Vocabulary and merges of a byte-level BPE with word ends, as a language of token pairs.

    A sequence of tokens is what merging yields exactly if every two neighbours are compatible: merging their joined
    bytes yields these two again. So every prefix of a word has one possible last token, the one that ends there and is
    compatible with the last token of what precedes it.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        byte = _byte_of()
        symbols: dict[int, tuple[int, ...]] = {}
        for text, number in vocabulary.items():
            if len(text.removesuffix(WORD_END)) == 1:
                symbols[number] = (byte[text[0]] + (LAST if text.endswith(WORD_END) else 0),)
        if len(symbols) != 2 * LAST:
            raise ValueError("the vocabulary does not hold all bytes, within and at the end of a word")
        #: rank of the merge of two tokens; rank at which a token is made, and its two parts
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if whole in symbols or max(self.made.get(a, -1), self.made.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} makes a token twice or before its parts")
            self.rank[a, b] = self.made[whole] = rank
            self.parts[whole] = (a, b)
            symbols[whole] = symbols[a] + symbols[b]
        self.size = {t: len(s) for t, s in symbols.items()}
        self.pairs: dict[int, bool] = {}
        self.spine = lru_cache(PAIRS)(self._spine)
        # A token whose own halves do not stay apart until its merge never comes out of merging.
        reached = {t for t, s in symbols.items() if len(s) == 1}
        for whole in sorted(self.parts, key=self.made.__getitem__):
            if reached.issuperset(self.parts[whole]) and self._first_crossing(*self.parts[whole]) == self.made[whole]:
                reached.add(whole)
        self.automaton = SuffixAutomaton()
        at = {self.automaton.add(symbols[t])[-1]: t for t in sorted(reached)}
        #: transitions, also as sorted arrays for many words at once
        self.edges = {state << SHIFT | symbol: to for state, symbol, to in self.automaton.edges()}
        # Tokens that end a state's string: the longest in state `here`, and from there `shorter` and shorter.
        states = len(self.automaton.link)
        self.token, self.here, self.shorter = [at.get(s, -1) for s in range(states)], [0] * states, [0] * states
        for state in sorted(range(1, states), key=self.automaton.length.__getitem__):
            self.shorter[state] = self.here[self.automaton.link[state]]
            self.here[state] = state if self.token[state] >= 0 else self.shorter[state]
        self.keys = np.array(sorted(self.edges))
        self.targets = np.array([self.edges[k] for k in self.keys.tolist()])
        self.np_link, self.np_length = np.array(self.automaton.link), np.array(self.automaton.length)
        self.np_token, self.np_here, self.np_shorter = map(np.array, (self.token, self.here, self.shorter))
        self.np_size = np.array([self.size.get(t, 0) for t in range(max(self.size) + 1)])

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at one end of a token while it is merged, each with the rank that ends it."""
        out = [(token, NEVER)]
        while token in self.parts:
            end, token = self.made[token], self.parts[token][side]
            out.append((token, end))
        return out

    def _first_crossing(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of two tokens, or NEVER. A merge happens when both parts stand; at
        equal rank the one further left goes first."""
        found = NEVER
        for x, ends_x in self.spine(a, 1):
            for y, ends_y in self.spine(b, 0):
                rank = self.rank.get((x, y), NEVER)
                if rank < ends_x and rank <= ends_y and rank < found:
                    found = rank
        return found

    def _fits(self, pair: int) -> bool:
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = self._first_crossing(pair >> PAIR_SHIFT, pair & (1 << PAIR_SHIFT) - 1) == NEVER
        return found

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word, in one pass over its prefixes."""
        edges, link, length = self.edges, self.automaton.link, self.automaton.length
        last: list[int] = []
        state = read = 0
        for i, symbol in enumerate(word):
            if i == len(word) - 1:
                symbol += LAST
            while (to := edges.get(state << SHIFT | symbol)) is None:
                state = link[state]
                read = length[state]
            state, read = to, read + 1
            at = self.here[state] if read == length[state] else self.here[link[state]]
            while (before := i - self.size[self.token[at]]) >= 0 and not self._fits(last[before] << PAIR_SHIFT | self.token[at]):
                at = self.shorter[at]
            last.append(self.token[at])
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words as 32-bit words in bytes. Words of ordinary length advance side by side, one prefix of each
        at a time; longer ones are encoded alone."""
        out: list[bytes] = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE), key=lambda i: -len(words[i]))
        for i, word in enumerate(words):
            if len(word) > SIDE_BY_SIDE:
                out[i] = np.array(self.encode(word), np.int32).tobytes()
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        begin = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join([words[i] for i in short]), np.uint8).astype(np.int64)
        symbols[begin + sizes - 1] += LAST
        last = np.empty(len(symbols), np.int64)
        state = np.zeros(len(short), np.int64)
        read = np.zeros(len(short), np.int64)
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i))  # words with a symbol at i
            self._advance(state[:n], read[:n], symbols[begin[:n] + i])
            s = state[:n]
            at = self.np_here[np.where(read[:n] == self.np_length[s], s, self.np_link[s])]
            open_ = np.arange(n)
            while len(open_):
                token = self.np_token[at[open_]]
                back = i - self.np_size[token]
                open_, token, back = open_[back >= 0], token[back >= 0], back[back >= 0]
                pair, place = np.unique(last[begin[open_] + back] << PAIR_SHIFT | token, return_inverse=True)
                bad = ~np.fromiter(map(self._fits, pair.tolist()), bool, len(pair))[place]
                open_ = open_[bad]
                at[open_] = self.np_shorter[at[open_]]
            last[begin[:n] + i] = self.np_token[at]
        # From the end of each word back to its begin: what is marked stays.
        keep = np.zeros(len(symbols), bool)
        end = begin + sizes - 1
        while len(end):
            keep[end] = True
            end = end - self.np_size[last[end]]
            begin, inside = begin[end >= begin], end >= begin
            end = end[inside]
        counts = np.add.reduceat(keep, np.cumsum(sizes) - sizes)
        ids = last[keep].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(short, [0, *ends], ends):
            out[i] = ids[a:b]
        return out

    def _advance(self, state: np.ndarray, read: np.ndarray, symbol: np.ndarray) -> None:
        """One more symbol for each word's match; where the automaton has no way on, the match gets shorter first."""
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] << SHIFT | symbol[open_]
            place = np.searchsorted(self.keys, key)
            there = self.keys[np.minimum(place, len(self.keys) - 1)] == key
            went = open_[there]
            state[went] = self.targets[place[there]]
            read[went] += 1
            open_ = open_[~there]
            state[open_] = self.np_link[state[open_]]
            read[open_] = self.np_length[state[open_]]


class Codec:
    """Ids of whole texts for a file of the `tokenizers` library, and texts of ids, as the library gives them with
    add_special_tokens=False and skip_special_tokens=False, without truncation or padding.

    Read from the file: NFC, white space and lower case as normalisation, a pattern that picks the words, byte-level
    symbols, word ends. Any other kind of file is refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content["pre_tokenizer"]["pretokenizers"][0]
        normal = [n["type"] for n in content["normalizer"]["normalizers"]]
        if (model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["dropout"] or content["decoder"]
                or normal != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]):
            raise ValueError(f"not a lower-casing BPE vocabulary with word ends: {path}")
        marks = {t["content"]: t for t in content["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in marks.values()):
            raise ValueError(f"an added token of {path} is not matched as it stands")
        self.tokens = Tokens(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        names = {number: text for text, number in model["vocab"].items()} | {t["id"]: c for c, t in marks.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.added = {c: np.array([t["id"]], np.int32).tobytes() for c, t in marks.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None
        # `\s` of the library is the Unicode property, which leaves out four control characters.
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.space, self.control = regex.compile(r"\p{White_Space}+"), regex.compile("[\x1c-\x1f]")
        self.units: dict[str, bytes] = {}
        self.letters = 0

    def _split(self, text: str) -> list[str]:
        """Units between white space: no word crosses it and no character composes with it."""
        return self.space.split(text) if self.control.search(text) else text.split()

    def _words_of(self, unit: str) -> list[str]:
        if unit.isascii():
            unit = unit.lower()
            return [unit] if unit.isalpha() else self.word.findall(unit)
        # Lower case goes by letter, not by place in a word.
        return self.word.findall(unicodedata.normalize("NFC", unit).replace("Σ", "σ").lower())

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of some units. They are kept for later ones, up to a number of letters."""
        words = list(map(self._words_of, units))
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.tokens.encode_all([w.encode() for w in distinct]), strict=True)).__getitem__
        made = {u: ids(found[0]) if len(found) == 1 else b"".join(map(ids, found)) for u, found in zip(units, words, strict=True)}
        letters = sum(map(len, units))
        if self.letters + letters > CACHE_LETTERS:
            self.units.clear()
            self.letters = 0
        if letters <= CACHE_LETTERS:
            self.units.update(made)
            self.letters += letters
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit words."""
        sections = [self.at_added.split(t) if self.at_added and self.at_added.search(t) else [t] for t in texts]
        units = [[self._split(x) if i % 2 == 0 else x for i, x in enumerate(parts)] for parts in sections]
        wanted = {u for parts in units for found in parts[::2] for u in found}
        ids = {u: got for u in wanted if (got := self.units.get(u)) is not None}
        ids.update(self._learn(list(wanted - ids.keys())))
        get = ids.__getitem__
        return [b"".join([b"".join(map(get, x)) if i % 2 == 0 else self.added[x] for i, x in enumerate(parts)]) for parts in units]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with a space between; ids that the file does not have give nothing."""
        names, top = self.names, len(self.names)
        return " ".join([n for i in ids if 0 <= i < top and (n := names[i]) is not None])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode(path: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(path)
        for batch in batches:
            letters = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)) // CHUNK_LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(letters)) + 1), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                rows = batch.slice(begin, end - begin)
                coded = with_ids.encode([t or "" for t in rows.column(0).to_pylist()])
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                ids = np.frombuffer(b"".join(coded), np.int32)
                made = [*rows.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded:
                    made.append(pa.array([with_ids.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(made, names=[*rows.schema.names[1:], "ids", *(["decoded"] if decoded else [])])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(path)
        for batch in batches:
            texts = [None if row.as_py() is None else with_ids.decode([i for i in row.as_py() if i is not None])
                     for row in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[1:], "decoded"])

    return run


def _beside(rows: DataFrame, source: str, keep: list[str], made: list[tuple[str, str]], run: Callable) -> DataFrame:
    """The columns `keep` under their own names beside the columns that `run` makes of `source`."""
    place = [f"_k{i}" for i in range(len(keep))]
    given = rows.select(F.col(source).alias("_source"), *[F.col(c).alias(p) for c, p in zip(keep, place, strict=True)])
    kinds = [f"{p} {rows.schema[c].dataType.simpleString()}" for c, p in zip(keep, place, strict=True)]
    out = spread(given, *place[:1]).mapInArrow(run, ", ".join([*kinds, *(f"{n} {t}" for n, t in made)]))
    return out.select(*[F.col(p).alias(c) for c, p in zip(keep, place, strict=True)], *[n for n, _ in made])


def encode(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The columns `keep` of every document with its token `ids` (array of int), and with `decoded` the text of these ids.

    A word's ids come from one pass over its prefixes: a suffix automaton over the vocabulary gives the tokens that end
    at a byte, longest first; the first one compatible with the last token of the rest is the prefix's last token, and
    following these back from the end gives the word. Texts are read once, whole, without a shuffle; ids of
    units met before, up to `CACHE_LETTERS` letters in all, are kept per worker.

    Defined cases: a null or empty text has no ids; added tokens of the file within a text get their ids; rows that
    repeat an id are separate documents; nulls in kept columns stay null, kept columns may have any name but `ids` and
    `decoded`; an empty table gives no rows; a very long word costs time and memory in proportion to its length.
    """
    made = [("ids", "array<int>"), *([("decoded", "string")] if decoded else [])]
    return _beside(docs, text_col, keep, made, _encode(tokenizer, decoded))


def decode(rows: DataFrame, tokenizer: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` with `decoded`: the texts of the ids, a space between two. Word ends and the characters that
    stand for bytes remain, since the file names no decoder.

    Defined cases: null ids give a null text, no ids an empty one; null entries and ids that the file lacks are left
    out; an empty table gives no rows.
    """
    return _beside(rows, ids_col, keep, [("decoded", "string")], _decode(tokenizer))
