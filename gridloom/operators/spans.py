"""Statistics of many spans of one array at once, in time that grows with the number of spans, not with their lengths.

A span is what lies from ``lo`` (included) to ``hi`` (excluded); all values are finite.
"""

from __future__ import annotations

import numpy as np


def moments(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population variance) of each span that isn't empty.

    Blocks of 1, 2, 4 ... values are summed up first, and a span is put together from two blocks of each length at most. Means and squares about them are merged, never
    subtracted, so a large offset costs no digits, and spans of equal values have the variance 0.
    """
    n, mean, squares = np.zeros(len(lo)), np.zeros(len(lo)), np.zeros(len(lo))
    lo, hi, size = lo.astype(np.int64), hi.astype(np.int64), 1.0
    block_mean, block_squares = values.astype(float), np.zeros(len(values))

    def merge(at: np.ndarray, block: np.ndarray) -> None:
        total = n[at] + size
        apart = block_mean[block] - mean[at]
        squares[at] += block_squares[block] + apart * apart * (n[at] * size / total)
        mean[at] += apart * (size / total)
        n[at] = total

    while True:
        at = np.flatnonzero((lo < hi) & (lo & 1 == 1))
        merge(at, lo[at])
        lo[at] += 1
        at = np.flatnonzero((lo < hi) & (hi & 1 == 1))
        merge(at, hi[at] - 1)
        hi[at] -= 1
        if not (lo < hi).any():
            return mean, squares / np.maximum(n, 1)
        lo, hi = lo >> 1, hi >> 1
        a, b = block_mean[: len(block_mean) // 2 * 2 : 2], block_mean[1::2]
        block_squares = block_squares[: len(a) * 2 : 2] + block_squares[1::2] + (b - a) ** 2 * (size / 2)
        block_mean, size = a + (b - a) / 2, size * 2


class Ordered:
    """Values of spans by their order: a wavelet matrix of the values' ranks, of one count for each value and bit of a rank."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        self.ranks = np.empty(len(values), np.int32)
        self.ranks[order] = np.arange(len(values), dtype=np.int32)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        held = self.ranks
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            zero = (held >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before, int(before[-1])))
            held = np.concatenate([held[zero], held[~zero]])

    def value(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each span; k must be less than the span's length."""
        lo, hi, k, rank = lo.astype(np.int32), hi.astype(np.int32), k.astype(np.int32), np.zeros(len(lo), np.int32)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            lo, hi = np.where(up, lo - a + zeros, a), np.where(up, hi - b + zeros, b)
            rank |= up.astype(np.int32) << bit
        return self.sorted[rank]

    def median(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        return (self.value(lo, hi, (n - 1) // 2) + self.value(lo, hi, n // 2)) / 2

    def quartile_distance(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The median of a span's upper half less that of its lower half (the middle one of an odd number is in neither)."""
        n = hi - lo
        half = n // 2
        of = lambda first: (self.value(lo, hi, first + (half - 1) // 2) + self.value(lo, hi, first + half // 2)) / 2
        return of(n - half) - of(np.zeros_like(n))

    def median_distance(self, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The median of the distances of a span's values from its centre.

        The values nearest to a centre follow each other in order of value; the first of them is found by halving.
        """
        n = hi - lo
        k = (n + 1) // 2
        first, last = np.zeros_like(n), n - k
        open_ = np.flatnonzero(first < last)
        while len(open_):
            middle = (first[open_] + last[open_]) // 2
            below, above = self.value(lo[open_], hi[open_], middle), self.value(lo[open_], hi[open_], middle + k[open_])
            right = centre[open_] - below > above - centre[open_]
            first[open_] = np.where(right, middle + 1, first[open_])
            last[open_] = np.where(right, last[open_], middle)
            open_ = open_[first[open_] < last[open_]]
        apart = lambda place, at=slice(None): np.abs(self.value(lo[at], hi[at], place) - centre[at])
        found = np.maximum(apart(first), apart(first + k - 1))
        # of an even number, the next one counts too: it lies at one of the two ends
        even = np.flatnonzero(n % 2 == 0)
        then = np.full(len(even), np.inf)
        for place in (first[even] - 1, first[even] + k[even]):
            there = np.flatnonzero((place >= 0) & (place < n[even]))
            then[there] = np.minimum(then[there], apart(place[there], even[there]))
        found[even] = (found[even] + then) / 2
        return found

    def mean_distance(self, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The mean of the distances of a span's values from its centre.

        Sums are differences of running sums, so values are split into whole multiples of a power of two, whose sums are exact, and small rests.
        """
        count = len(self.ranks)
        most = max(float(np.abs(self.sorted[[0, -1]]).max()), float(np.abs(centre).max(initial=0.0)))
        # a sum of the multiples stays below 2 ** 60
        scale = 60 - int(count).bit_length() - int(np.frexp(most)[1])
        whole = lambda x: np.rint(np.ldexp(x, scale))
        sorted_whole = whole(self.sorted)
        rest = self.sorted - np.ldexp(sorted_whole, -scale)
        centre_whole = whole(centre)
        centre_rest, centre_whole = centre - np.ldexp(centre_whole, -scale), centre_whole.astype(np.int64)
        sorted_whole = sorted_whole.astype(np.int64)
        limit = np.searchsorted(self.sorted, centre, side="right").astype(np.int32)

        def sums(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate([np.zeros(1, v.dtype), np.cumsum(v[ranks])]) for v in (sorted_whole, rest))

        # of the values above the centre: their number, and the sums of both parts; levels are walked from the highest bit of the ranks on
        n_up, whole_up, rest_up = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), np.zeros(len(lo))
        a, b, held = lo.astype(np.int64), hi.astype(np.int64), self.ranks
        # a limit of 2 ** bits has no value above it
        inside = limit < count
        for bit, before, zeros in self.levels:
            held = np.concatenate([held[(held >> bit) & 1 == 0], held[(held >> bit) & 1 == 1]])
            running = sums(held)
            za, zb = before[a], before[b]
            oa, ob = a - za + zeros, b - zb + zeros
            one = (limit >> bit) & 1 == 1
            add = inside & ~one
            n_up += np.where(add, ob - oa, 0)
            whole_up += np.where(add, running[0][ob] - running[0][oa], 0)
            rest_up += np.where(add, running[1][ob] - running[1][oa], 0.0)
            a, b = np.where(one, oa, za), np.where(one, ob, zb)
        # what is left has the limit's own rank
        running = sums(held)
        n_up += np.where(inside, b - a, 0)
        whole_up += np.where(inside, running[0][b] - running[0][a], 0)
        rest_up += np.where(inside, running[1][b] - running[1][a], 0.0)
        running = sums(self.ranks)
        n = (hi - lo).astype(np.int64)
        whole_all, rest_all = running[0][hi] - running[0][lo], running[1][hi] - running[1][lo]
        whole_sum = 2 * (whole_up - n_up * centre_whole) - (whole_all - n * centre_whole)
        rest_sum = 2 * (rest_up - n_up * centre_rest) - (rest_all - n * centre_rest)
        return (np.ldexp(whole_sum.astype(float), -scale) + rest_sum) / np.maximum(n, 1)
