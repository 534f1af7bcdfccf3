"""All pieces of a vocabulary inside many words at once, and sums over all ways to cut words into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = 0xC2B2AE3D27D4EB4F


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Numbers of pieces by a 64-bit hash of their letters, looked up for whole arrays of substrings."""

    def __init__(self, names: list[str]) -> None:
        self.none = len(names)
        self.longest = max(map(len, names), default=1)
        self.bits = max(12, (8 * len(names)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        by_length: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            by_length.setdefault(len(name), []).append(i)
        for length, group in by_length.items():
            letters, h = codes([names[i] for i in group]), np.zeros(len(group), np.uint64)
            for at in range(length):
                h = self.add(h, letters[:, at])
            for i, key in zip(group, self.key(h, length).tolist(), strict=True):
                slot = key >> (64 - self.bits)
                while self.ids[slot] >= 0:
                    slot = (slot + 1) % len(self.ids)
                self.keys[slot], self.ids[slot] = key, i

    @staticmethod
    def add(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return h * _BASE + (letter + np.uint64(1))

    @staticmethod
    def key(h: np.ndarray, length: int) -> np.ndarray:
        return _mixed(h + np.uint64(length * _LENGTH % (1 << 64)))

    def find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), self.none, np.int32)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == key[left])
            out[left[hit]] = ids[hit]
            on = (ids >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) % len(self.ids)
        return out

    def arcs(self, words: list[str]) -> np.ndarray:
        """[start, length - 1, word]: the piece there, or `none`. All words have one length."""
        letters = codes(words)
        n = letters.shape[1]
        ids = np.full((n, min(n, self.longest), len(words)), self.none, np.int32)
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, min(ids.shape[1], n - start) + 1):
                h = self.add(h, letters[:, start + k - 1])
                ids[start, k - 1] = self.find(self.key(h, k))
        return ids


def codes(words: list[str]) -> np.ndarray:
    """[word, letter]: code points of equally long words."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4").reshape(len(words), -1).astype(np.uint64)


def by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Places of words of one length, at most `most` at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for group in groups.values():
        for at in range(0, len(group), most):
            yield group[at:at + most]


def best_cuts(ids: np.ndarray, score: np.ndarray, floor: float) -> list[list[int]]:
    """For words of one length the pieces of the most likely cut, in order. `score` ends with minus infinity for no piece; a
    letter that no piece covers stands for itself at `floor`, as no piece. Of equal cuts the longest last piece wins."""
    n, widest, words = ids.shape
    best, back = np.full((n + 1, words), -np.inf), np.ones((n + 1, words), np.int32)
    best[0] = 0.0
    for end in range(1, n + 1):
        for start in range(max(0, end - widest), end):
            found = best[start] + score[ids[start, end - start - 1]]
            better = found > best[end]
            best[end][better], back[end][better] = found[better], end - start
        open_ = best[end] == -np.inf
        best[end][open_] = best[end - 1][open_] + floor
    out = []
    for w, steps in enumerate(back.T.tolist()):
        at, cut = n, []
        while at > 0:
            k = steps[at]
            at -= k
            cut.append(int(ids[at, k - 1, w]))
        out.append(cut[::-1])
    return out


def expected_uses(ids: np.ndarray, prob: np.ndarray, weight: np.ndarray, uses: np.ndarray) -> None:
    """Add to `uses` how often each piece is expected over all ways to cut words of one length. `prob` ends with a 0 for
    no piece; `weight` says how often each word counts."""
    n, widest, words = ids.shape
    arcs = [(start, k) for start in range(n) for k in range(1, min(n - start, widest) + 1)
            if ids[start, k - 1].min() < len(prob) - 1]
    ahead, behind = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    ahead[0] = behind[n] = 1
    for start, k in arcs:  # starts ascend: what leads to a start is complete
        ahead[start + k] += ahead[start] * prob[ids[start, k - 1]]
    share = weight / ahead[n]
    for start, k in reversed(arcs):
        behind[start] += behind[start + k] * prob[ids[start, k - 1]]
    for start, k in arcs:
        arc = ids[start, k - 1]
        uses += np.bincount(arc, ahead[start] * prob[arc] * behind[start + k] * share, len(uses))
