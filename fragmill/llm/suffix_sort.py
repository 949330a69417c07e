"""Sorting of fixed-length suffixes by polynomial prefix hashes, for many short texts at once.

Two suffixes are compared by the hash of their common extension: binary search over its length takes a logarithmic number of
steps whatever the suffixes share.  A mergesort of all ties runs over numpy arrays, one step of all merges at a time.  A hash
can only claim too much to be equal, so the sorted neighbours are compared byte by byte; after a collision the sort runs
again with other hashes.
"""

from __future__ import annotations

import numpy as np


def hash_numbers(seed: int) -> tuple[np.ndarray, int]:
    """A random odd number for every byte and a random odd base, modulo 2 ** 64."""
    rng = np.random.default_rng([20_260_101, seed])
    table = rng.integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[:256], int(table[256])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int) -> int:
    """Of an odd number modulo 2 ** 64."""
    return pow(base, -1, 2**64)


class Suffixes:
    """The suffixes at offsets of texts that stand one after the other, cut to length bytes.

    owner is the text of each suffix and offset its place there; every suffix has at least length bytes in its text."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray, owner: np.ndarray, offset: np.ndarray, length: int, seed: int):
        table, base = hash_numbers(seed)
        sizes = np.diff(np.append(text_starts, len(data)))
        longest = int(sizes.max(initial=1))
        place = np.arange(len(data)) - np.repeat(text_starts, sizes)
        self.prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(table[data] * powers(base, longest)[place], dtype=np.uint64)])
        self.shift = powers(inverse(base), longest)[offset]
        self.data, self.at, self.length = data, text_starts[owner] + offset, length
        self.whole = self.hashes(np.arange(len(owner)), length)

    def hashes(self, which: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        at = self.at[which]
        return (self.prefix[at + length] - self.prefix[at]) * self.shift[which]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: the byte behind the longest common extension decides."""
        out = np.zeros(len(a), dtype=np.int8)
        open_ = np.flatnonzero(self.whole[a] != self.whole[b])
        a, b = a[open_], b[open_]
        same, differ = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length, dtype=np.int64)
        for _ in range(self.length.bit_length()):
            middle = (same + differ) >> 1
            equal = self.hashes(a, middle) == self.hashes(b, middle)
            same, differ = np.where(equal, middle, same), np.where(equal, differ, middle)
        same = np.minimum(same, self.length - 1)
        x, y = self.data[self.at[a] + same], self.data[self.at[b] + same]
        out[open_] = (x > y).astype(np.int8) - (x < y)
        return out

    def first_bytes(self) -> np.ndarray:
        """The first eight bytes of each suffix as a number that sorts as they do."""
        out = np.zeros(len(self.at), dtype=np.uint64)
        for k in range(min(8, self.length)):
            out = (out << np.uint64(8)) | self.data[self.at + k]
        return out

    def merged(self, order: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """order with the stretches [start, stop) of each place sorted, by merging sorted runs of 1, 2, 4, ... places."""
        width, longest = 1, int((stop - start).max(initial=0))
        while width < longest:
            at = np.flatnonzero(stop - start > width)
            base = start[at] + (at - start[at]) // (2 * width) * (2 * width)
            middle, end = np.minimum(base + width, stop[at]), np.minimum(base + 2 * width, stop[at])
            left = at < middle
            # a place of the left run goes behind the smaller ones of the right run, one of the right run behind equal ones too
            low, high = np.where(left, middle, base), np.where(left, end, middle)
            own, first = np.where(left, at - base, at - middle), low.copy()
            while len(open_ := np.flatnonzero(low < high)):
                probe = (low[open_] + high[open_]) >> 1
                behind = self.compare(order[probe], order[at[open_]]) < left[open_].astype(np.int8) * -1 + 1
                low[open_], high[open_] = np.where(behind, probe + 1, low[open_]), np.where(behind, high[open_], probe)
            moved = order.copy()
            moved[base + own + low - first] = order[at]
            order, width = moved, 2 * width
        return order

    def ordered(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes sorted within each group, and whether each is the same as the one before it."""
        words = self.first_bytes()
        order = np.lexsort((words, groups))
        tie = np.zeros(len(order), dtype=bool)
        tie[1:] = (groups[order[1:]] == groups[order[:-1]]) & (words[order[1:]] == words[order[:-1]])
        starts = np.flatnonzero(~tie)
        sizes = np.diff(np.append(starts, len(order)))
        order = self.merged(order, np.repeat(starts, sizes), np.repeat(starts + sizes, sizes))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (groups[order[1:]] == groups[order[:-1]]) & (self.whole[order[1:]] == self.whole[order[:-1]])
        return order, same

    def verified(self, groups: np.ndarray, order: np.ndarray, same: np.ndarray, rows: int = 65_536) -> bool:
        """Whether the bytes of all neighbours in a group agree with the order and with what counts as the same."""
        places = np.arange(self.length)
        for k in range(1, len(order), rows):
            a, b = order[k - 1 : k + rows - 1], order[k : k + rows]
            a = a[: len(b)]
            x, y = self.data[self.at[a][:, None] + places], self.data[self.at[b][:, None] + places]
            differ = x != y
            first, row = differ.argmax(1), np.arange(len(b))
            equal = ~differ.any(1)
            in_group = groups[a] == groups[b]
            right = np.where(same[k : k + rows], equal, x[row, first] < y[row, first])
            if not right[in_group].all():
                return False
        return True


def sort_suffixes(data: np.ndarray, text_starts: np.ndarray, owner: np.ndarray, offset: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes in their groups and whether each is the same as the one before, by hashes that collide nowhere here."""
    seed = 0
    while True:
        suffixes = Suffixes(data, text_starts, owner, offset, length, seed)
        order, same = suffixes.ordered(groups)
        if suffixes.verified(groups, order, same):
            return order, same
        seed += 1
