"""Suffix automata over words: which stretches of a text stand in a set of passages, and how early."""

from __future__ import annotations

from collections.abc import Iterable

NEVER = (1 << 63) - 1


class SuffixAutomaton:
    """All runs of words of the passages added to it, each with the smallest number of a passage that has it.

    A state stands for runs that end at the same places; ``link`` leads to the state of the longest shorter one
    that ends at more places. Passages are added in any order, then :meth:`close` is called once.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [NEVER]
        self.at_least: list[int] = []

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(NEVER)
        return len(self.next) - 1

    def _split(self, state: int, word) -> int:
        """The state of exactly the runs of ``state`` followed by ``word``; of longer ones a copy is set apart."""
        there = self.next[state][word]
        if self.length[there] == self.length[state] + 1:
            return there
        copy = self._state(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: Iterable, number: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                state = last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, word)
                last = new
            if number < self.first[last]:
                self.first[last] = number

    def close(self, least: int) -> None:
        """Spread the smallest numbers to shorter runs, and find for every state where its run of ``least`` words is."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            up = self.link[state]
            if self.first[state] < self.first[up]:
                self.first[up] = self.first[state]
        self.at_least = [NEVER] * len(self.next)
        for state in order:
            if self.length[state] >= least:
                up = self.link[state]
                self.at_least[state] = self.at_least[up] if self.length[up] >= least else self.first[state]
        self.least = least

    def spans(self, words: list, number: int) -> list[tuple[int, int]]:
        """The maximal spans (from, to) of ``words`` whose every run of ``least`` words stands in a passage of a smaller
        number: the matching statistics of the words, cut at ``least``."""
        found: list[tuple[int, int]] = []
        state = size = 0
        for place, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            # A longer match than the state's own runs allow can't be: sizes follow the links down.
            if size >= self.least and self.at_least[state] < number:
                a = place + 1 - self.least
                if found and found[-1][1] >= a:
                    found[-1] = (found[-1][0], place + 1)
                else:
                    found.append((a, place + 1))
        return found
