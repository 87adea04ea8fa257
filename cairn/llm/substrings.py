"""Exact repeats of `width` bytes across documents, by sparse suffix arrays in logarithmic index families.

A byte is removed when a `width`-byte string that covers it also starts in a document with a smaller doc_id.

Every string of `width` bytes has one anchor: the least hash among its K-byte substrings, the leftmost of equals. Equal
strings have equal anchors, so only strings with the same anchor are ever compared. Blocks of texts first send which
anchors they have and how often; the shards answer which are found in several documents, and which of these are hot. For
those, a block sends each distinct context (the bytes of the anchor's strings) once, with its smallest doc_id; contexts
of hot anchors are cut into their strings, which are dealt over all shards by their own hashes.

In a shard an index family finds the repeats. Contexts come in batches in the order of doc_id. A batch gets its suffix
array: the places of its suffixes of at least `width` bytes in order of their first `width` bytes, with the least doc_id
of those that share them (a longer match is a run of such places). It is merge-scanned against the existing levels, both
in sorted order, for matches of the full width, and joins them as a level; levels of equal size merge, so there are
logarithmically many. A mask of the strings that start in a smaller document returns to the block.

Defined cases: a null text is empty; repeats inside a document don't count; rows with equal doc_id never remove each
other's bytes; a null doc_id counts as larger than all others; texts shorter than `width` lose nothing; repeated rows
repeat in the result; all text is bytes, so a removed run may split a character; other columns are not read; doc_id is
of an integer type.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import shared, textvec
from cairn.llm.lm import pack, pack_sorted, shard_of, spans, unpack, unpack_sorted

WIDTH, K = 50, 25
#: Text bytes of a block; anchors of a shard; strings of a new batch.
BLOCK_BYTES, SHARD_ANCHORS, BATCH = 6 << 20, 250_000, 1 << 17
#: An anchor with more occurrences than this is hot. Suffixes of a level that a merge scan reads at a time.
HOT, CHUNK = 20_000, 1 << 15
LAST = (1 << 63) - 1

_P = 0xD1B54A32D192ED03 | 1
_P_INV = pow(_P, -1, 1 << 64)
_CODE = np.random.default_rng(411).integers(1, 1 << 63, 256, dtype=np.uint64)
#: String starts that are hashed at a time: what they need stays in the processor's cache.
_STEP = 1 << 16
_PLACE = 20  # bits of a place among them


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 1024, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P), _powers(_P_INV)


class Anchors:
    """Anchors of a block's texts: `at`, their hashes, and the runs of string starts (`begin`, `count`) they stand for."""

    def __init__(self, texts: list[bytes], width: int, k: int):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.size) - self.size
        self.joined = b"".join(texts)
        b = np.frombuffer(self.joined, np.uint8)
        n = len(b)
        none = np.zeros(0, np.int64)
        self.at, self.begin, self.count, self.hash, self.owner = none, none, none, np.zeros(0, np.uint64), none
        if n < width:
            return
        turn = np.zeros(n + 1, np.int8)  # where starts of whole strings begin and end
        full = self.size >= width
        np.add.at(turn, self.first[full], 1)
        np.add.at(turn, self.first[full] + self.size[full] - width + 1, -1)
        runs, carry = [], np.int8(0)
        for x in range(0, n - width + 1, _STEP):
            y = min(x + _STEP, n - width + 1)
            inside = np.cumsum(turn[x:y], dtype=np.int8) + carry
            carry = inside[-1]
            start = np.flatnonzero(inside)
            if len(start):
                hashes = self._hash(b[x : y + width - 1], k)
                at = self._least(hashes, width - k + 1)[start]
                new = np.ones(len(start), bool)
                new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
                run = np.flatnonzero(new)
                runs.append((at[run] + x, start[run] + x, np.diff(np.append(run, len(start))), hashes[at[run]]))
        if not runs:
            return
        at, begin, count, hashes = map(np.concatenate, zip(*runs, strict=True))
        new = np.ones(len(at), bool)  # a run may go on in the next step
        new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + count[:-1])
        first = np.flatnonzero(new)
        self.at, self.begin, self.hash = at[first], begin[first], hashes[first]
        self.count = np.add.reduceat(count, first)
        self.owner = np.searchsorted(self.first, self.begin, "right") - 1

    @staticmethod
    def _hash(b: np.ndarray, k: int) -> np.ndarray:
        """Hash of every k-byte substring, whatever its place."""
        n = len(b)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[b] * _POW[:n], out=total[1:])
        h = total[k:] - total[:-k]
        h *= _INV[: n - k + 1]
        return textvec.mix(h)

    @staticmethod
    def _least(hashes: np.ndarray, w: int) -> np.ndarray:
        """Place of the least of every w hashes in a row, the leftmost of equals."""
        least = hashes & ~np.uint64((1 << _PLACE) - 1)
        least |= np.arange(len(hashes), dtype=np.uint64)
        have, n = 1, len(hashes) - w + 1
        while 2 * have <= w:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < w:
            least = np.minimum(least[:n], least[w - have : w - have + n])
        return (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


class Level:
    """A suffix array: `at`, places in `text` in order of the `width` bytes there, and the least id that has each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int):
        self.text, self.at, self.ids, self.width = text, at, ids, width

    def __len__(self) -> int:
        return len(self.at)

    def keys(self, x: int, y: int) -> np.ndarray:
        """The bytes that the suffixes x to y begin with."""
        return np.ndarray(len(self.text) - self.width + 1, f"S{self.width}", self.text, strides=(1,))[self.at[x:y]]

    @classmethod
    def of(cls, contexts: list[bytes], ids: np.ndarray, width: int) -> tuple[Level, np.ndarray]:
        """The suffix array of contexts; and of each of their strings, in order, its place there."""
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        # no byte of UTF-8 is 0xFF: adding one leaves no zero, which numpy's strings would drop at their end
        text = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(1)
        many = size - width + 1
        begin = np.repeat(np.cumsum(size) - size, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        whole = cls(text, begin, np.repeat(ids, many), width)
        key = whole.keys(0, len(begin))
        order = np.argsort(key)
        common = key[order[1:]] == key[order[:-1]]  # the longest common prefix of neighbours is at least width
        new = np.concatenate([[True], ~common])
        place = np.empty(len(begin), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return cls(text, begin[order][first], np.minimum.reduceat(whole.ids[order], first), width), place

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix of another level, its place in this one, and whether it is there: one pass over both."""
        place, same = np.full(len(other), len(self), np.int64), np.zeros(len(other), bool)
        x, mine = 0, self.keys(0, CHUNK)
        for y in range(0, len(other), CHUNK):
            key, done = other.keys(y, y + CHUNK), 0
            while x < len(self) and done < len(key):
                to = done + int(np.searchsorted(key[done:], mine[-1], "right"))
                at = np.searchsorted(mine, key[done:to])
                place[y + done : y + to] = x + at
                same[y + done : y + to] = mine[at] == key[done:to]
                done = to
                if done < len(key):
                    x += CHUNK
                    mine = self.keys(x, x + CHUNK)
        return place, same

    def merged(self, other: Level) -> Level:
        """Both in one: suffixes that both have once, with the lesser id."""
        place, same = self.scan(other)
        ids = self.ids.copy()
        ids[place[same]] = np.minimum(ids[place[same]], other.ids[same])
        own = ~same
        return Level(np.concatenate([self.text, other.text]), np.insert(self.at, place[own], other.at[own] + len(self.text)), np.insert(ids, place[own], other.ids[own]), self.width)


class Family:
    """Suffix arrays in levels, each more than half as large again as the next."""

    def __init__(self, width: int):
        self.levels: list[Level] = []
        self.width = width

    def add(self, contexts: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The least id of each string of the contexts, among the levels and themselves; they become a level."""
        level, place = Level.of(contexts, ids, self.width)
        found = level.ids.copy()
        for old in self.levels:
            at, same = old.scan(level)
            found[same] = np.minimum(found[same], old.ids[at[same]])
        while self.levels and 2 * len(self.levels[-1]) <= 3 * len(level):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return found[place]


def earlier(contexts: list[bytes], ids: list[int], width: int) -> list[int]:
    """For each context, a mask of its strings of `width` bytes that have a smaller id elsewhere; bit j: the j-th."""
    order = sorted(range(len(contexts)), key=ids.__getitem__)
    out = [0] * len(contexts)
    family, at = Family(width), 0
    while at < len(order):
        batch: dict[bytes, int] = {}  # equal contexts of a batch are one, of the least id
        to, n = at, 0
        while to < len(order) and (n < BATCH or ids[order[to]] == ids[order[to - 1]]):
            c = contexts[order[to]]
            if c not in batch:
                batch[c] = ids[order[to]]
                n += len(c) - width + 1
            to += 1
        kinds = list(batch)
        least = family.add(kinds, np.fromiter(batch.values(), np.int64, len(kinds)))
        many = np.fromiter(map(len, kinds), np.int64, len(kinds)) - width + 1
        first = np.cumsum(many) - many
        hit = least < np.repeat(np.fromiter(batch.values(), np.int64, len(kinds)), many)
        bits = np.add.reduceat(hit.astype(np.int64) << (np.arange(len(hit)) - np.repeat(first, many)), first)
        masks = dict(zip(kinds, bits.tolist(), strict=True))
        for i in order[at:to]:
            c = contexts[i]  # a copy of a larger id has all its strings in the one of the least
            out[i] = masks[c] if ids[i] == batch[c] else (1 << len(c) - width + 1) - 1
        at = to
    return out


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts in blocks, stored, so that what later steps say of a block holds for the same texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        def close(rows):
            texts = [t for _, t in rows]
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "ids": pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "texts": [zstandard.compress(b"".join(texts), 3)], "n_bytes": pa.array([sum(map(len, texts))], pa.int64())})

        rows, size = [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), textvec.as_bytes(b.column(1)), strict=True):
                if rows and size + len(t) > BLOCK_BYTES:
                    yield close(rows)
                    rows, size = [], 0
                rows.append((i, t))
                size += len(t)
        if rows:
            yield close(rows)

    core = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return shared.stored(core.mapInArrow(run, "block string, ids array<bigint>, sizes array<bigint>, texts binary, n_bytes long"), "substrings-blocks")


class _Block:
    def __init__(self, ids, sizes, texts, width: int, k: int, bits: int):
        import zstandard

        whole = zstandard.decompress(texts)
        at = np.cumsum([0, *sizes]).tolist()
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.a = Anchors([whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], width, k)
        # anchors are least hashes: mixed again, they spread evenly over the shards
        self.value = textvec.mix(self.a.hash) >> np.uint64(64 - bits)
        self.bits, self.width, self.k = bits, width, k

    def seen(self):
        """Sorted distinct anchor values, how often the block has each, and whether two of its documents do."""
        order = np.argsort(self.value, kind="stable")
        v, d = self.value[order], self.ids[self.a.owner[order]]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        run = np.flatnonzero(new)
        several = np.minimum.reduceat(d, run) != np.maximum.reduceat(d, run) if len(run) else np.zeros(0, bool)
        return v[run], np.diff(np.append(run, len(v))), several

    def _cool(self, hot: np.ndarray, values: np.ndarray) -> None:
        """Cuts the runs of hot anchors into single strings, which go by their own hashes."""
        a = self.a
        warm = hot[np.searchsorted(values, self.value)] if len(values) else hot
        if not warm.any():
            return
        single = np.where(warm, a.count, 1)
        step = np.arange(single.sum()) - np.repeat(np.cumsum(single) - single, single)
        warm = np.repeat(warm, single)
        a.begin, a.owner, a.count = np.repeat(a.begin, single) + step, np.repeat(a.owner, single), np.where(warm, 1, np.repeat(a.count, single))
        self.value = np.repeat(self.value, single)
        own = a.begin[warm]
        hashes = np.empty(len(own), np.uint64)
        buf = np.frombuffer(a.joined, np.uint8)
        for x in range(0, len(buf) - self.width + 1, _STEP):  # runs rise, so each step has a slice of them
            lo, hi = np.searchsorted(own, [x, x + _STEP])
            if hi > lo:
                hashes[lo:hi] = Anchors._hash(buf[x : x + _STEP + self.width - 1], self.width)[own[lo:hi] - x]
        self.value[warm] = textvec.mix(hashes) >> np.uint64(64 - self.bits)

    def contexts(self, live: np.ndarray, hot: np.ndarray):
        """Of live anchors: distinct contexts in order of the value they go by, their smallest ids and these values; and
        for each live run its index and its context's."""
        values, _, _ = self.seen()
        if len(values):
            at = np.searchsorted(values, self.value)
            self.a.begin, self.a.count, self.a.owner, self.value = (x[live[at]] for x in (self.a.begin, self.a.count, self.a.owner, self.value))
            self._cool(hot, values)
        on = np.argsort(self.value, kind="stable")
        a, known, found, least, first, which = self.a, {}, [], [], [], []
        joined, get = a.joined, known.get
        ids = self.ids[a.owner[on]].tolist()
        ends = (a.begin + a.count - 1 + self.width)[on].tolist()
        for j, (s, e, i) in enumerate(zip(a.begin[on].tolist(), ends, ids, strict=True)):
            c = joined[s:e]
            n = get(c)
            if n is None:
                known[c] = n = len(found)
                found.append(c)
                least.append(i)
                first.append(j)
            elif i < least[n]:
                least[n] = i
            which.append(n)
        return found, np.array(least, np.int64), self.value[on[np.array(first, np.int64)]], on, np.array(which, np.int64)


def _shard(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Shards of sorted values, rising."""
    return shard_of(values << np.uint64(64 - bits), n)


def live_anchors(table: DataFrame, n: int, bits: int, width: int, k: int) -> DataFrame:
    """For each block and shard, bits for each of the block's anchor values there: several documents have it; it is hot."""

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for block, ids, sizes, texts in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                v, often, several = _Block(ids, sizes, texts, width, k, bits).seen()
                own = spans(_shard(v, bits, n))
                code = often.astype(np.uint64) * np.uint64(2) + several.astype(np.uint64)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _, _ in own], pa.int64()), "block": pa.array([block] * len(own), pa.string()), "seen": [pack_sorted(v[x:y]) for _, x, y in own], "often": [pack(code[x:y]) for _, x, y in own]})

    def answer(group):
        import pyarrow as pa

        parts = [unpack_sorted(x) for x in group.column("seen").to_pylist()]
        code = np.concatenate([unpack(x) for x in group.column("often").to_pylist()])
        v, place = np.unique(np.concatenate(parts), return_inverse=True)
        live = np.bincount(place, 1 + (code & np.uint64(1)), len(v)) > 1
        hot = live & (np.bincount(place, code >> np.uint64(1), len(v)) > HOT)
        at = np.cumsum([0, *map(len, parts)])
        both = [pack(live[place[x:y]].astype(np.uint64) + hot[place[x:y]]) for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "live": pa.array(both, pa.binary())})

    sent = table.select("block", "ids", "sizes", "texts").mapInArrow(send, "shard long, block string, seen binary, often binary").repartition(n, "shard")
    return shared.stored(sent.groupBy("shard").applyInArrow(answer, "block string, shard long, live binary"), "substrings-live")


def _live(right) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of a block's anchor values is live, and hot."""
    rows = sorted(zip(right.column("shard").to_pylist(), right.column("live").to_pylist(), strict=True))
    code = np.concatenate([unpack(b) for _, b in rows]) if rows else np.zeros(0, np.uint64)
    return code > 0, code > 1


def removed(docs: DataFrame, width: int = WIDTH, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, spans (begin, end in bytes) and kept (the remaining bytes) of every row."""
    if not 0 < k <= width or width - k + 1 > 62:
        raise ValueError("a mask has one bit for each string of a context: width - k + 1 must be 62 at most")
    table = blocks(docs, key, text)
    size = table.agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("blocks")).first()
    total, tasks = size["bytes"] or 0, max(1, 2 * size["blocks"])
    expected = max(1, 2 * total // (width - k + 2))
    n, bits = max(4, -(-expected // SHARD_ANCHORS)), min(64, max(32, expected.bit_length() + 12))
    live = live_anchors(table, n, bits, width, k)
    core = table.select("block", "ids", "sizes", "texts")

    def block_of(left) -> _Block:
        return _Block(left.column("ids")[0].as_py(), left.column("sizes")[0].as_py(), left.column("texts")[0].as_py(), width, k, bits)

    def send(left, right):
        import pyarrow as pa

        import zstandard

        one = block_of(left)
        found, least, values, _, _ = one.contexts(*_live(right))
        rows = spans(_shard(values, bits, n))
        block = left.column("block")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([k for k, _, _ in rows], pa.int64()),
                "block": pa.array([block] * len(rows), pa.string()),
                "contexts": pa.array([zstandard.compress(b"".join(found[x:y]), 1) for _, x, y in rows], pa.binary()),
                "sizes": pa.array([pack(np.fromiter(map(len, found[x:y]), np.int64, y - x)) for _, x, y in rows], pa.binary()),
                "docs": pa.array([pack(least[x:y]) for _, x, y in rows], pa.binary()),
            }
        )

    def answer(group):
        import pyarrow as pa

        import zstandard

        contexts, ids, counts = [], [], []
        for c, z, d in zip(*(group.column(x).to_pylist() for x in ("contexts", "sizes", "docs")), strict=True):
            whole, size, at = zstandard.decompress(c), unpack(z).tolist(), 0
            counts.append(len(size))
            for s in size:
                contexts.append(whole[at : at + s])
                at += s
            ids += unpack(d).astype(np.int64).tolist()
        masks = np.array(earlier(contexts, ids, width), np.uint64)
        at = np.cumsum([0, *counts])
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "masks": pa.array([pack(masks[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    live = live.repartition(tasks, "block")
    sent = core.repartition(tasks, "block").groupBy("block").cogroup(live.groupBy("block")).applyInArrow(send, "shard long, block string, contexts binary, sizes binary, docs binary").repartition(n, "shard")
    masks = shared.stored(sent.groupBy("shard").applyInArrow(answer, "block string, shard long, masks binary"), "substrings-masks")

    def finish(left, right):
        import pyarrow as pa
        import pyarrow.compute

        own = left.filter(pa.compute.is_valid(left.column("texts")))
        one = block_of(own)
        found, low, _, on, which = one.contexts(*_live(left.filter(pa.compute.is_valid(left.column("live")))))
        a = one.a
        step = np.zeros(len(a.joined) + 1, np.int64)
        if len(found):
            rows = sorted(zip(right.column("shard").to_pylist(), right.column("masks").to_pylist(), strict=True))
            mask = np.concatenate([unpack(m) for _, m in rows])[which]
            least = low[which]
            count = a.count[on]
            # a smaller document of the same block has the whole context
            mask = np.where(one.ids[a.owner[on]] > least, (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1), mask)
            for j in range(int(count.max())):
                hit = a.begin[on][(mask >> np.uint64(j)) & np.uint64(1) > 0] + j
                np.add.at(step, hit, 1)
                np.add.at(step, hit + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        buf = np.frombuffer(a.joined, np.uint8)
        cols = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
        for x, size in zip(a.first.tolist(), a.size.tolist(), strict=True):
            g = gone[x : x + size]
            k1 = int(g.sum())
            turns = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)) if k1 else np.zeros(0, np.int64)
            cols["n_bytes"].append(size)
            cols["n_removed"].append(k1)
            cols["n_spans"].append(len(turns) // 2)
            cols["spans"].append(turns.tolist())
            cols["kept"].append(buf[x : x + size][~g].tobytes() if k1 else a.joined[x : x + size])
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.int64()), "kept": pa.binary()}
        return pa.table({"key": pa.array(own.column("ids")[0].as_py(), pa.int64()), **{c: pa.array(v, kinds[c]) for c, v in cols.items()}})

    both = core.unionByName(live, allowMissingColumns=True).repartition(tasks, "block")
    out = both.groupBy("block").cogroup(masks.repartition(tasks, "block").groupBy("block")).applyInArrow(finish, "key long, n_bytes long, n_removed long, n_spans long, spans array<bigint>, kept binary")
    return out.withColumnRenamed("key", key)

