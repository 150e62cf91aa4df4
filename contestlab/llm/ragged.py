"""Ids of words, each word encoded once a worker and then looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

CACHE_WORDS = 400_000


#: Characters of texts that are split into words together.
SLICE_CHARS = 1 << 22


def slices(texts, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``chars`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def spread_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + len), one range after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


class WordIds:
    """A bounded cache from word to ids; beyond ``limit`` words it starts anew.

    ``encode`` gets a list of new words and returns all their ids in one array and each word's number of ids.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.flat, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add words, each given once and not known yet."""
        ids, lens = self.encode(words)
        n, m = len(self.known), len(ids)
        while n + len(words) > len(self.lens):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.lens)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lens[n : n + len(words)] = lens
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + m] = ids
        self.used += m
        self.known.update(zip(words, range(n, n + len(words))))

    def ids(self, words: list[str]) -> np.ndarray:
        try:
            which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.offer(words)
            which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.flat[spread_ranges(self.starts[which], self.lens[which])]

    def offer(self, words: Iterable[str]) -> None:
        """Learn the new ones of many texts' words together; afterwards all the given words are known."""
        words = list(dict.fromkeys(words))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit and self.known:
            self.clear()
            new = words
        if new:
            self.learn(new)
