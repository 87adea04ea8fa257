"""Byte-level BPE from a rank file: merges by a segment tree over byte positions, and decoding.

A pattern splits a text into pieces, and each piece that isn't a token itself is merged on its own. Every byte position
that begins a part holds the rank of the token which that part and its right neighbour would make, or none; the tree keeps
the leftmost minimum over all positions. Its root names the next merge. A merge takes the neighbour's place off the tree,
gives its own place the rank with the new neighbour, and the place to the left the rank with the new part: three point
updates of logarithmic length among live neighbours, so a piece of n bytes takes time in proportion to n log n. The tree is
one array of eight bytes a node.

Short pieces that a batch of texts brings anew are merged together: their trees are rows of one array, and a turn makes the
next merge of each. They are remembered; the memory of that is bounded. A long piece has a tree of its own. Ids are decoded by joining
their bytes; the text they spell is the UTF-8 of those, with malformed parts as U+FFFD.

Defined cases: a null text is an empty one; an empty text has no tokens and decodes to no bytes; strings of special tokens
are ordinary text; what the pattern doesn't match is left out, which for the public pattern is nothing; equal rows
give equal rows; other columns of the input, whatever their names, are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import array
import base64
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points on whose letters, numbers and white space all Unicode versions agree; for others the public library is asked.
_COMMON = regex.compile("[\\x00-\u0557\u0590-\u05f4\u2010-\u206f\u20a0-\u20b5\u2190-\u23f3\u2500-\u2b55\u3000-\u30ff\u4e00-\u9fcc\uac00-\ud7a3\uff01-\uffee\U0001f300-\U0001f64f]*")
#: Pieces of at most so many bytes are merged together and remembered, so many of them.
SHORT, KEPT = 64, 200_000
#: Characters whose pieces are listed at a time.
CHUNK = 1 << 19
#: Bits of a tree node that hold the position; the rank is above them.
_PLACE = 40
_NONE = (1 << 63) - 1


class Ranks:
    """Tokens and their ranks, which are their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}

    @classmethod
    def load(cls, path: str) -> Ranks:
        """A rank file: a line of base64 and rank for each token."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token})

    def merge(self, piece: bytes) -> array.array:
        """Ids of a piece by its lowest-ranked merges, the leftmost first among equals."""
        rank, n = self.ranks.get, len(piece)
        whole = rank(piece)
        if whole is not None or n < 2:
            if n and whole is None:
                raise ValueError("the vocabulary lacks a byte")
            return array.array("I", [whole] if n else [])
        leaf = 1 << (n - 1).bit_length()
        tree = array.array("q", [_NONE]) * (2 * leaf)
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                tree[leaf + i] = r << _PLACE | i
        for i in range(leaf - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = array.array("q", range(1, n + 1)), array.array("q", range(-1, n - 1))

        def put(i: int, value: int) -> None:
            """Point update: the minima above leaf i, up to the first that stays."""
            i += leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least

        def pair(i: int, to: int) -> int:
            r = rank(piece[i:to])
            return _NONE if r is None else r << _PLACE | i

        mask = (1 << _PLACE) - 1
        while (best := tree[1]) != _NONE:
            i = best & mask
            gone = after[i]
            right = after[gone]
            after[i] = right
            put(gone, _NONE)
            if right < n:
                before[right] = i
                put(i, pair(i, after[right]))
            else:
                put(i, _NONE)
            left = before[i]
            if left >= 0:
                put(left, pair(left, right))
        out, i = array.array("I"), 0
        while i < n:
            r = rank(piece[i : after[i]])
            if r is None:
                raise ValueError("the vocabulary lacks a byte")
            out.append(r)
            i = after[i]
        return out


class Forest:
    """The trees of many short pieces, in which each turn makes the next merge of every piece that has one.

    A part is known by its id, and `made` is a sorted table of the pairs of ids whose bytes joined are a token.
    """

    def __init__(self, ranks: Ranks):
        known = ranks.ranks
        pairs = {}
        for token, rank in known.items():
            for k in range(1, len(token)):
                a, b = known.get(token[:k]), known.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 31 | b] = rank
        self.made = np.array(sorted(pairs) or [-1], np.int64)
        self.rank = np.array([pairs[k] for k in sorted(pairs)] or [0], np.int64)
        self.byte = np.array([known.get(bytes([b]), -1) for b in range(256)], np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Nodes of the pairs (a, b) of ids at these places."""
        key = a << 31 | b
        at = np.minimum(np.searchsorted(self.made, key), len(self.made) - 1)
        return np.where(self.made[at] == key, self.rank[at] << _PLACE | place, _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of two bytes or more."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        leaves = 1 << np.ceil(np.log2(sizes)).astype(np.int64)
        for leaf in np.unique(leaves):
            some = np.flatnonzero(leaves == leaf)
            ids, ends = self._merge([pieces[i] for i in some], sizes[some], int(leaf))
            packed, begin = ids.astype("<u4").tobytes(), 0
            for i, end in zip(some.tolist(), (4 * ends).tolist(), strict=True):
                out[i], begin = packed[begin:end], end
        return out

    def _merge(self, pieces: list[bytes], n: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and where each piece's end."""
        count, span = len(pieces), np.arange(leaf)
        text = np.frombuffer(b"".join(p.ljust(leaf, b"\0") for p in pieces), np.uint8).reshape(count, leaf)
        part = self.byte[text]
        inside = span < n[:, None]
        if (part[inside] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        tree = np.full((count, 2 * leaf), _NONE)
        first = self._pair(part[:, :-1], part[:, 1:], span[:-1])
        tree[:, leaf : 2 * leaf - 1] = np.where(inside[:, 1:], first, _NONE)
        low = leaf
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after, before = np.tile(np.arange(1, leaf + 2), (count, 1)), np.tile(np.arange(-1, leaf), (count, 1))
        live, rows = inside.copy(), np.arange(count)
        while True:
            best = tree[rows, 1]
            rows, best = rows[best != _NONE], best[best != _NONE]
            if not len(rows):
                break
            at = best & ((1 << _PLACE) - 1)
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            part[rows, at], live[rows, gone], after[rows, at], before[rows, right] = best >> _PLACE, False, right, at
            some, more = right < n[rows], left >= 0
            nodes = [_NONE] * len(rows), np.full(len(rows), _NONE), self._pair(part[rows[more], left[more]], part[rows[more], at[more]], left[more])
            nodes[1][some] = self._pair(part[rows[some], at[some]], part[rows[some], right[some]], at[some])
            row = np.concatenate([rows, rows, rows[more]])
            node = np.concatenate([gone, at, left[more]]) + leaf
            tree[row, node] = np.concatenate(nodes)
            while node[0] > 1:  # all leaves are at the same depth
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        return part[live], np.cumsum(live.sum(axis=1))


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks.load(path)
        self.text_pattern = pattern
        self.pattern = regex.compile(pattern)
        self.exact = None
        self.forest = Forest(self.ranks)
        self.pieces: dict[str, bytes] = {}

    def _classes(self) -> regex.Pattern:
        """The pattern with letters, numbers and white space as the public library has them: it is asked which code points
        each class matches, since a text's unmatched parts give no tokens."""
        if self.exact is None:
            import tiktoken

            every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
            pattern = self.text_pattern
            bare = {}
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                asked = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
                runs: list[list[int]] = []
                for c in map(ord, asked.decode_bytes(asked.encode_ordinary(every)).decode()):
                    if runs and runs[-1][1] == c - 1:
                        runs[-1][1] = c
                    else:
                        runs.append([c, c])
                bare[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
            inside, out, k = False, [], 0
            while k < len(pattern):  # a class is written bare inside brackets, in brackets outside
                name = next((x for x in (*bare, r"\S") if pattern.startswith(x, k)), None)
                if name == r"\S":
                    if inside:
                        raise ValueError(r"\S inside brackets")
                    out.append(f"[^{bare[chr(92) + 's']}]")
                elif name:
                    out.append(bare[name] if inside else f"[{bare[name]}]")
                else:
                    name = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
                    inside = name == "[" or (inside and name != "]")
                    out.append(name)
                k += len(name)
            self.exact = regex.compile("".join(out))
        return self.exact

    def _learn(self, met: set[str]) -> dict[str, bytes]:
        """Packed ids of at least these pieces; short ones are remembered."""
        known, rank = self.pieces, self.ranks.ranks.get
        new = met - known.keys()
        if len(known) + len(new) > KEPT:
            known.clear()
            new = met
        grown, long = [], {}
        for piece in new:
            raw = piece.encode()
            whole = rank(raw)
            if len(raw) > SHORT:
                long[piece] = self.ranks.merge(raw).tobytes()
            elif whole is not None or len(raw) < 2:
                known[piece] = self.ranks.merge(raw).tobytes()
            else:
                grown.append((piece, raw))
        known.update(zip((p for p, _ in grown), self.forest.merge([raw for _, raw in grown]), strict=True))
        return known | long if long else known

    def encode(self, texts: list[str], chunk: int = CHUNK) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Of all texts, the pieces of about chunk characters
        are listed at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            known = self._learn(set().union(*(found for _, found in held)))
            for i, found in held:
                out[i].append(b"".join(map(known.__getitem__, found)))
            held.clear()

        for i, text in enumerate(texts):
            pattern = self.pattern if _COMMON.fullmatch(text) else self._classes()
            if len(text) <= chunk:
                held.append((i, pattern.findall(text)))
                size += len(text)
                if size >= chunk:
                    flush()
                    size = 0
                continue
            found = (hit[0] for hit in pattern.finditer(text))
            while some := list(islice(found, max(1, chunk // 8))):
                held.append((i, some))
                flush()
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, packed: bytes) -> bytes:
        """Bytes that packed ids spell."""
        return b"".join(map(self.ranks.bytes_of.__getitem__, memoryview(packed).cast("I")))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded bytes of each row of docs, in one pass without a shuffle. The rank file must
    lie at path on the executors."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                packed = e.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(map(e.decode, packed), pa.binary())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of decimal ids with commas between them) and decoded_sha256 of what encode_decode returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
