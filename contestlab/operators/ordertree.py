"""Order statistics of growing histories, for all rows of many histories at once.

Elements of a history stand in time order and carry the rank of their value. A counting tree over
the bits of the ranks tells how many elements of any stretch of time lie in any range of ranks; a
k-th smallest value is one walk from its root, a step a bit. All rows walk side by side, so there
is no loop over rows. An element may stand for many equal ones: it has a count and weighted sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _upto(x: np.ndarray) -> np.ndarray:
    """Sums before each place; those of weights in long doubles, as short stretches are differences of long ones."""
    out = np.zeros(len(x) + 1, np.longdouble if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=out[1:])
    return out


class CountTree:
    """Counts and sums by rank in stretches [lo, hi) of a sequence of ranked elements."""

    def __init__(self, rank: np.ndarray, count: np.ndarray | None = None, sums: tuple[np.ndarray, ...] = ()):
        self.levels, at = [], np.arange(len(rank))
        for bit in reversed(range(max(1, int(rank.max(initial=0)).bit_length()))):
            high = (rank[at] >> bit & 1).astype(bool)
            low = _upto(~high)
            counts = low if count is None else _upto(np.where(high, 0, count[at]))
            parts = [(_upto(np.where(high, 0.0, s[at])), _upto(np.where(high, s[at], 0.0))) for s in sums]
            self.levels.append((bit, low, counts, parts))
            at = np.concatenate([at[~high], at[high]])
        self.sums = len(sums)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rank of the k-th smallest element (from 0) of each stretch."""
        rank = np.zeros(len(lo), np.int64)
        for bit, low, counts, _ in self.levels:
            a, b, zeros = low[lo], low[hi], low[-1]
            n = b - a if counts is low else counts[hi] - counts[lo]
            high = k >= n
            k = np.where(high, k - n, k)
            rank += high.astype(np.int64) << bit
            lo, hi = np.where(high, lo - a + zeros, a), np.where(high, hi - b + zeros, b)
        return rank

    def split(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each sum over the elements of a lower rank, and over those of a higher one."""
        below, above = ([np.zeros(len(lo), np.longdouble) for _ in range(self.sums)] for _ in range(2))
        for bit, low, _, parts in self.levels:
            high = (rank >> bit & 1).astype(bool)
            for i, (s, t) in enumerate(parts):
                below[i] += np.where(high, s[hi] - s[lo], 0.0)
                above[i] += np.where(high, 0.0, t[hi] - t[lo])
            a, b, zeros = low[lo], low[hi], low[-1]
            lo, hi = np.where(high, lo - a + zeros, a), np.where(high, hi - b + zeros, b)
        return below, above


@dataclass
class Stretches:
    """One column of a batch: the elements of its histories, and for each asked row the stretch of its past."""

    tree: CountTree
    values: np.ndarray  # of all ranks of all histories
    known: np.ndarray  # False where a value stands for others between its neighbours
    first: np.ndarray  # per asked row: place of its history's rank 0 in values
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    totals: list[np.ndarray]  # per asked row: the sums over its past

    def only(self, rows: np.ndarray) -> Stretches:
        return Stretches(self.tree, self.values, self.known, self.first[rows], self.lo[rows], self.hi[rows], self.n[rows], [t[rows] for t in self.totals])

    def rank(self, k: np.ndarray) -> np.ndarray:
        return self.tree.kth(self.lo, self.hi, k)

    def value(self, k: np.ndarray) -> np.ndarray:
        return self.values[self.first + self.rank(k)]

    def sure(self, rank: np.ndarray) -> np.ndarray:
        """The values of ranks that results come from."""
        if not self.known[self.first + rank].all():
            raise AssertionError("an order statistic fell among values that are only counted")
        return self.values[self.first + rank]


def stretches(history: np.ndarray, value: np.ndarray, used: np.ndarray, asked: np.ndarray, strict: bool, count: np.ndarray | None = None, known: np.ndarray | None = None, sums: tuple[np.ndarray, ...] = ()) -> Stretches:
    """From rows in (history, time) order. ``history`` numbers the histories from 0; ``used`` rows are elements,
    ``asked`` rows want the statistics of their past, which ends before them if ``strict``."""
    place = _upto(used)
    at = np.flatnonzero(used)
    h, v = history[at], value[at]
    order = np.lexsort((v, h))
    new = np.ones(len(at), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (v[order][1:] != v[order][:-1])
    number = np.cumsum(new) - 1
    histories = int(history.max(initial=-1)) + 1
    first = np.searchsorted(h[order][new], np.arange(histories), "left")
    rank = np.empty(len(at), np.int64)
    rank[order] = number - first[h[order]]
    values, sure = v[order][new], np.ones(int(new.sum()), bool)
    if known is not None:
        np.logical_and.at(sure, number, known[at][order])
    taken, counts = tuple(s[at] for s in sums), count[at] if count is not None else None
    rows = np.flatnonzero(asked)
    starts = place[np.searchsorted(history, np.arange(histories), "left")]
    lo, hi = starts[history[rows]], place[rows if strict else rows + 1]
    many = _upto(counts if counts is not None else np.ones(len(at), np.int64))
    whole = [_upto(s) for s in taken]
    return Stretches(CountTree(rank, counts, taken), values, sure, first[history[rows]], lo, hi, many[hi] - many[lo], [w[hi] - w[lo] for w in whole])


def _distance(s: Stretches, mid: np.ndarray, before: np.ndarray, after: np.ndarray, nearer: bool) -> np.ndarray:
    """Of the ``before``-th value left of the middle and the ``after``-th from it on, counted from 1, the distance
    of the nearer or the farther one; one that does not exist is never taken."""
    half = s.n // 2
    a, b = s.rank(np.clip(half - before, 0, s.n - 1)), s.rank(np.clip(half + after - 1, 0, s.n - 1))
    none = np.inf if nearer else -1.0
    left = np.where((before > 0) & (before <= half), mid - s.values[s.first + a], none)
    right = np.where((after > 0) & (after <= s.n - half), s.values[s.first + b] - mid, none)
    out = np.minimum(left, right) if nearer else np.maximum(left, right)
    s.sure(np.where(left == out, a, b))
    return out


def median_and_mad(s: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, median absolute deviation, and the rank of the upper median, of stretches that are not empty."""
    half, even = s.n // 2, np.flatnonzero(s.n % 2 == 0)
    pairs = s.only(even)
    upper = s.rank(half)
    mid = s.sure(upper)
    mid[even] = (pairs.sure(pairs.rank(half[even] - 1)) + mid[even]) / 2
    # the k + 1 values nearest to mid are the last i before it and the first k + 1 - i from it on
    k = (s.n - 1) // 2
    lo, hi = np.maximum(0, k + 1 - (s.n - half)), np.minimum(k + 1, half)
    left = np.flatnonzero(lo < hi)
    while len(left):
        part, m = s.only(left), mid[left]
        i = (lo[left] + hi[left]) // 2
        more = m - part.value(half[left] - 1 - i) < part.value(half[left] + k[left] - i) - m
        lo[left], hi[left] = np.where(more, i + 1, lo[left]), np.where(more, hi[left], i)
        left = left[lo[left] < hi[left]]
    took = k + 1 - lo
    mad = _distance(s, mid, lo, took, False)
    mad[even] = (mad[even] + _distance(pairs, mid[even], lo[even] + 1, took[even] + 1, True)) / 2
    return mid, mad, upper


def weighted_deviation(s: Stretches, mid: np.ndarray, upper: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Weighted mean of |x - mid|; the sums of the stretches are weight and weight times (x - centre)."""
    (w0, x0), above = s.tree.split(s.lo, s.hi, upper)
    _, later = s.tree.split(s.lo, s.hi, np.maximum(upper - 1, 0))
    # what equals the median deviates by nothing, so it is left out rather than cancelled
    same, all_later = s.values[s.first + upper] == mid, upper == 0
    w1, x1 = (np.where(same, a, np.where(all_later, t, b)) for a, b, t in zip(above, later, s.totals))
    m = mid - centre
    return (np.maximum((m * w0 - x0) + (x1 - m * w1), 0.0) / s.totals[0]).astype(float)


def clipped_moments(s: Stretches, low: float, high: float, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted mean and variance of values clipped to two elements of the sorted past, and the weight.

    The sums of the stretches are weight, and weight times (x - centre) and its square.
    """
    a, b = s.rank(((s.n - 1) * low).astype(np.int64)), s.rank(((s.n - 1) * high).astype(np.int64))
    va, vb = s.sure(a) - centre, s.sure(b) - centre
    below, _ = s.tree.split(s.lo, s.hi, a)
    _, above = s.tree.split(s.lo, s.hi, b)
    w, x, xx = (t - lo - hi for t, lo, hi in zip(s.totals, below, above))
    mean = (va * below[0] + x + vb * above[0]) / s.totals[0]
    square = (va * va * below[0] + xx + vb * vb * above[0]) / s.totals[0]
    spread = np.where(va == vb, 0.0, np.maximum(square - mean * mean, 0.0))
    return (centre + np.where(va == vb, va, mean)).astype(float), spread.astype(float), s.totals[0].astype(float)
