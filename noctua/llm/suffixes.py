"""Suffix order, earlier matches and longest previous factors of the windows of a buffer, with numpy.

The order is by the first `length` bytes of each suffix: ranks of 8 bytes are tripled to 24, 72 and so on, and three
ranks that overlap give the last depth. In suffix order, the previous and the next smaller position of a window are the
nearest earlier places on both sides; the longest previous factor is the longer match of the two.
"""

from __future__ import annotations

import numpy as np


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of keys, equal for equal ones."""
    order = np.argsort(keys)
    put = keys[order]
    rank = np.zeros(len(keys), np.int64)
    rank[order[1:]] = np.cumsum(put[1:] != put[:-1])
    return rank


def joined_rank(parts: list[np.ndarray]) -> np.ndarray:
    """Ranks of tuples of ranks."""
    bits = max(int(parts[0].max(initial=0)), *(int(p.max(initial=0)) for p in parts[1:]), 1).bit_length()
    if bits * len(parts) <= 63:
        key = parts[0]
        for p in parts[1:]:
            key = (key << bits) | p
        return dense(key)
    rank = parts[0]
    for p in parts[1:]:
        rank = dense((rank << 32) | p)
    return rank


class SuffixOrder:
    """The windows at `at`, increasing places in raw, each of `length` bytes within it."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, length: int):
        self.at, self.length = at, length
        padded = np.concatenate([raw, np.zeros(length, np.uint8)])
        self.levels = [(1, padded)]
        width = min(8, length)
        key = np.zeros(len(raw), np.uint64)
        for k in range(width):
            key = (key << np.uint64(8)) | padded[k : k + len(raw)]
        depth, rank = width, dense(key)
        while depth < length:
            self.levels.append((depth, np.concatenate([rank, np.zeros(length, np.int64)])))
            wide = self.levels[-1][1]
            if 3 * depth >= length:  # the last depth is asked of windows only
                steps = (0, length - depth) if 2 * depth >= length else (0, depth, length - depth)
                depth, rank = length, joined_rank([wide[at + s] for s in steps])
                break
            rank = joined_rank([wide[s : s + len(raw)] for s in (0, depth, 2 * depth)])
            depth *= 3
        else:
            rank = rank[at]
        self.rank = rank
        #: windows, as places in `at`, in suffix order; equal ones by place
        self.order = np.argsort(rank, kind="stable")
        self._nearest()

    def _nearest(self) -> None:
        """previous and next: for each window, the window at the previous and next smaller position in suffix order; -1: none."""
        n = len(self.at)
        place = np.concatenate([self.order, [-1]])  # place[-1] is smaller than all
        self.previous, self.next = np.empty(n, np.int64), np.empty(n, np.int64)
        for out, step in ((self.previous, -1), (self.next, 1)):
            to = np.append(np.arange(n) + step, -1)
            if step > 0 and n:
                to[n - 1] = -1
            open_ = np.flatnonzero(place[to[:n]] > place[:n])
            while len(open_):  # all between a place and its pointer are larger: jump along the pointer's own
                to[open_] = to[to[open_]]
                open_ = open_[place[to[open_]] > place[open_]]
            out[self.order] = place[to[:n]]

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that windows a and b share from their start, up to length; 0 where b is -1."""
        i, j = self.at[a], self.at[b]
        same = np.where(self.rank[a] == self.rank[b], self.length, 0)
        left = np.flatnonzero((b >= 0) & (same == 0))
        i, j, shared = i[left], j[left], np.zeros(len(left), np.int64)
        for depth, rank in reversed(self.levels):
            for _ in range(7 if depth == 1 else 2):
                shared += depth * ((rank[i + shared] == rank[j + shared]) & (shared + depth <= self.length))
        same[left] = shared
        return np.where(b >= 0, same, 0)

    def longest_previous_factors(self) -> np.ndarray:
        every = np.arange(len(self.at))
        return np.maximum(self.match(every, self.previous), self.match(every, self.next))

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(later, first): windows whose previous factor has the full length, and the earlier windows that these match."""
        later, first = np.zeros(len(self.at), bool), np.zeros(len(self.at), bool)
        for near in (self.previous, self.next):
            full = np.flatnonzero((near >= 0) & (self.rank == self.rank[near]))
            later[full] = True
            first[near[full]] = True
        return later, first & ~later
