"""Vectorised word hashing over UTF-8 buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased unless fold is off. All text of a call is one byte
array, so the cost is a few numpy passes and no Python loop over words. A word's hash is a polynomial over the ring of
64-bit integers, made independent of the word's place by the inverse power, then mixed.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text hashed at a time; a longer text is cut at white space, a longer word is kept whole.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _CODE.copy()
_CODE[65:91] = _CODE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _pow(name: str, base: int, n: int) -> np.ndarray:
    """base**i for i below n, kept and grown when needed."""
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK + 1), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= 4 * BLOCK:
            _powers[name] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(buf: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in a byte array."""
    hashes, starts, ends, at, n = [], [], [], 0, len(buf)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:  # move back to white space, else forward past the word
            gap = np.flatnonzero(_SPACE[buf[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                while to < n and not _SPACE[buf[to]]:
                    step = np.flatnonzero(_SPACE[buf[to : to + BLOCK]])
                    to = to + int(step[0]) if len(step) else min(n, to + BLOCK)
        h, s, e = _block(buf[at:to], _CODE if fold else _EXACT)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def _block(b: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(code[b] * _pow("p", _P, len(b)), out=total[1:])
        h = (total[ends] - total[starts]) * _pow("inv", _P_INV, len(b))[starts]
        h = mix(h + (ends - starts).astype(np.uint64))
    return h, starts, ends


class Texts:
    """The words of many texts: `hashes` of all, those of text i from first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        joined = b"\n".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.buf = np.frombuffer(joined, np.uint8)
        self.hashes, self.starts, self.ends = words_of(self.buf, fold)
        self.first = np.searchsorted(self.starts, np.concatenate([self.begin, [len(joined) + 1]]))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; len(h) - n + 1 of them, none if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words the whole sequence is one; none without words."""
    if not len(h):
        return h
    return np.unique(grams(h, min(n, len(h))))
