"""Elias-Fano sequences and an n-gram trie over them, in memory-mapped levels, searched in whole arrays of queries."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONE = np.uint64(1)


def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each 64-bit word."""
    at = np.zeros(len(word), np.int64)
    word, r = word.copy(), r.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        over = r >= low
        r -= low * over
        word >>= np.where(over, np.uint64(width), np.uint64(0))
        at += width * over
    return at


class EliasFano:
    """A non-decreasing sequence below `universe`: low bits packed, high parts in unary, ended by a zero each."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.universe = n, max(1, universe)
        self.bits = max(0, (self.universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        size = n + (self.universe >> self.bits) + 1
        upper = np.zeros(-(-size // 64) * 64, np.uint8)
        upper[high + np.arange(n)] = 1
        self.upper = np.packbits(upper, bitorder="little").view(np.uint64)
        if self.bits:
            low = values & np.uint64((1 << self.bits) - 1)
            planes = np.zeros(n * self.bits + 128, np.uint8)
            cells = planes[: n * self.bits].reshape(n, self.bits)
            for k in range(self.bits):
                cells[:, k] = (low >> np.uint64(k)) & _ONE
            packed = np.packbits(planes, bitorder="little")
            self.lower = packed[: len(packed) // 8 * 8].view(np.uint64)
        else:
            self.lower = np.zeros(1, np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.upper).astype(np.int64))])
        self.ones, self.zeros = ones, 64 * np.arange(len(ones)) - ones

    def arrays(self) -> dict[str, np.ndarray]:
        return {"upper": self.upper, "lower": self.lower, "ones": self.ones, "zeros": self.zeros}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.bits
        w, s = bit >> 6, (bit & 63).astype(np.uint64)
        both = (self.lower[w] >> s) | np.where(s > 0, self.lower[np.minimum(w + 1, len(self.lower) - 1)] << (np.uint64(64) - np.maximum(s, _ONE)), np.uint64(0))
        return both & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        w = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * w + _select(self.upper[w], i - self.ones[w])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """Number of elements before the k-th zero."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return 64 * w + _select(~self.upper[w], k - self.zeros[w]) - k

    def _seek(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element not below x, and whether it equals x."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = high <= self.universe >> self.bits
        h = np.where(inside, high, 0)
        at = np.where(h > 0, self._before_zero(np.maximum(h - 1, 0)), 0)
        want = x & np.uint64((1 << self.bits) - 1)
        end = self._before_zero(h)
        stop = end.copy()
        # the elements of a high part follow its zero; a dense context has many there, so halve the span
        live = np.flatnonzero(inside & (at < stop))
        while len(live):
            mid = (at[live] + stop[live]) >> 1
            below = self._low(mid) < want[live]
            at[live[below]] = mid[below] + 1
            stop[live[~below]] = mid[~below]
            live = live[at[live] < stop[live]]
        same = np.zeros(len(x), bool)
        near = np.flatnonzero(inside & (at < end))
        same[near] = self._low(at[near]) == want[near]
        return np.where(inside, at, self.n), same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element not below x; n if there is none."""
        return self._seek(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of an element equal to x, else -1."""
        if not self.n:
            return np.full(len(x), -1)
        at, same = self._seek(x)
        return np.where(same, at, -1)


class Trie:
    """Contexts, monotone pointers to their successors, the successors, and a byte of quantised probability for each.

    A successor is kept relative to its context: context rank times `words` plus the word, so one monotone sequence holds
    all and the search for a word is bounded by its context's pointers. All levels lie in one memory-mapped file.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray, n_words: int, n_contexts: int | None = None):
        """Of distinct (context, word) pairs in order; contexts lie below n_contexts, which is n_words unless given."""
        self.n_words = n_words
        new = np.ones(len(contexts), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        begin = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        self.contexts = EliasFano(contexts[begin], n_words if n_contexts is None else n_contexts)
        self.pointers = EliasFano(np.append(begin, len(contexts)), len(contexts) + 1)
        self.successors = EliasFano(rank.astype(np.uint64) * np.uint64(n_words) + words.astype(np.uint64), max(1, len(begin)) * n_words)
        self.codes = codes.astype(np.uint8)
        self._map()

    def _map(self) -> None:
        """Move every level to a file and map it; the file has no name and ends with the trie."""
        self.file = tempfile.TemporaryFile()
        places = []
        levels = (self.contexts, self.pointers, self.successors)
        for level in levels:
            for name, a in level.arrays().items():
                places.append((level, name, self.file.tell(), a.dtype, len(a)))
                self.file.write(a.tobytes())
        places.append((self, "codes", self.file.tell(), self.codes.dtype, len(self.codes)))
        self.file.write(self.codes.tobytes() + bytes(8))
        self.file.flush()
        self.size = os.fstat(self.file.fileno()).st_size
        whole = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
        for owner, name, at, kind, n in places:
            setattr(owner, name, whole[at : at + n * kind.itemsize].view(kind) if n else np.zeros(0, kind))

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 of those that are absent."""
        out = np.zeros(len(contexts), np.uint8)
        if not len(contexts) or not len(self.codes):
            return out
        new = np.ones(len(contexts), bool)  # a run of one context is found once
        new[1:] = contexts[1:] != contexts[:-1]
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(contexts)))
        rank = self.contexts.find(contexts[begin])
        end = np.zeros(len(rank), np.int64)
        end[rank >= 0] = self.pointers.access(rank[rank >= 0] + 1).astype(np.int64)
        rank, end = np.repeat(rank, run), np.repeat(end, run)
        known = np.flatnonzero(rank >= 0)
        x = rank[known].astype(np.uint64) * np.uint64(self.n_words) + words[known].astype(np.uint64)
        at, same = self.successors._seek(x)
        ok = same & (at < end[known])
        out[known[ok]] = self.codes[at[ok]]
        return out

    def close(self) -> None:
        self.file.close()
