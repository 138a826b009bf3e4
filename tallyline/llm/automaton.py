"""A generalised suffix automaton: all parts of several sequences in one graph."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """States stand for the parts of the sequences that end at the same places; `prefixes` has each sequence's state after each item."""

    def __init__(self, sequences: Iterable[Iterable[Hashable]]):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.prefixes: list[list[int]] = []
        for seq in sequences:
            last, passed = 0, []
            for c in seq:
                last = self._extend(last, c)
                passed.append(last)
            self.prefixes.append(passed)

    def _new(self, length: int, nxt: dict[Hashable, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: Hashable, q: int) -> int:
        """The state for exactly the strings of p followed by c, split from q if q has longer ones too."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: Hashable) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        state, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def ends(self) -> list[list[tuple[int, int]]]:
        """For each state where its strings end: (sequence, items before the end)."""
        out: list[set[tuple[int, int]]] = [set() for _ in self.len]
        for k, passed in enumerate(self.prefixes):
            for i, s in enumerate(passed, 1):
                out[s].add((k, i))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                out[self.link[s]] |= out[s]
        return [sorted(e) for e in out]

    def statistics(self, seq: Iterable[Hashable]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each place."""
        out, state, n = [], 0, 0
        for c in seq:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append((n, state))
        return out
