"""Suffix automata over sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All substrings of some sequences, one state per set of end positions.

    `link[s]` is the state of the longest suffix that ends in more places, `length[s]` the longest string of the state.
    State 0 is the empty string. Most states have one transition, so the first is kept in two lists and only others in
    dictionaries: about 100 bytes a state.
    """

    def __init__(self) -> None:
        self.link, self.length = [-1], [0]
        self._symbol, self._target = [-1], [-1]
        self._more: dict[int, dict[int, int]] = {}

    def step(self, state: int, symbol: int) -> int:
        """The state after one more symbol, or -1."""
        if self._symbol[state] == symbol:
            return self._target[state]
        more = self._more.get(state)
        return more.get(symbol, -1) if more else -1

    def edges(self) -> Iterator[tuple[int, int, int]]:
        """All transitions: state, symbol, next state."""
        for state, symbol in enumerate(self._symbol):
            if symbol >= 0:
                yield state, symbol, self._target[state]
        for state, others in self._more.items():
            for symbol, to in others.items():
                yield state, symbol, to

    def append(self, last: int, symbol: int) -> int:
        """Add one symbol after the sequence that ended in state `last` (0 starts a new one); the state it ends in."""
        link, length, first, target, more = self.link, self.length, self._symbol, self._target, self._more
        found = self.step(last, symbol)
        if found >= 0:  # only where another sequence went the same way
            return found if length[found] == length[last] + 1 else self._split(last, symbol, found)
        made = len(link)
        link.append(0)
        length.append(length[last] + 1)
        first.append(-1)
        target.append(-1)
        at = last
        while at >= 0:
            if first[at] == symbol:
                found = target[at]
                break
            if first[at] < 0:
                first[at], target[at] = symbol, made
            else:
                others = more.get(at)
                if others is None:
                    more[at] = {symbol: made}
                elif symbol in others:
                    found = others[symbol]
                    break
                else:
                    others[symbol] = made
            at = link[at]
        else:
            return made
        link[made] = found if length[found] == length[at] + 1 else self._split(at, symbol, found)
        return made

    def _split(self, at: int, symbol: int, found: int) -> int:
        """A state of its own for the shorter strings of `found`, those that follow `at`."""
        link, first, target, more = self.link, self._symbol, self._target, self._more
        made = len(link)
        link.append(link[found])
        self.length.append(self.length[at] + 1)
        first.append(first[found])
        target.append(target[found])
        if found in more:
            more[made] = more[found].copy()
        link[found] = made
        while at >= 0:
            if first[at] == symbol:
                if target[at] != found:
                    break
                target[at] = made
            elif more[at][symbol] == found:
                more[at][symbol] = made
            else:
                break
            at = link[at]
        return made

    def add(self, sequence: Iterable[int]) -> list[int]:
        """Append a whole sequence; the state that each of its prefixes ended in when it was appended."""
        states, last, append = [], 0, self.append
        for symbol in sequence:
            last = append(last, symbol)
            states.append(last)
        return states
