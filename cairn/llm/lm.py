"""Language-model scoring with bigram and trigram tries in Elias-Fano levels, dealt over shards.

P(w | v) = lam(v) * c(v, w) / c(v) + (1 - lam(v)) * (c(w) + 1/2) / (N + (V + 1) / 2), with lam(v) = c(v) / (c(v) + mu(v))
and mu(v) = 1 + 5 c(v)^0.85: a proper distribution over the vocabulary and one unknown word, but for rounding: the trie
keeps the smoothed share of the pair, lam(v) * c(v, w) / c(v), as a byte on a logarithmic scale of 255 steps over nine
decades, so a share is off by 4.2 % at most, and the sum of a context by less. In the same way
P(w | u, v) = lam(u, v) * c(u, v, w) / c(u, v) + (1 - lam(u, v)) * P(w | v), the beginning of a text being a word before
its first; the first word has no longer context. Level 3 has the rank of the pair (u, v) for its context.

Texts become blocks of token places, stored. Each block sends the words it has to the shards of their hashes, which add
up counts and return them with ids; then it sends its distinct pairs to the shards of their contexts, which build a trie
of the pairs of training texts, answer all pairs from it, and return a byte, the count and the id of each; then the same
is done with distinct triples, by the shards of their pairs. A triple with a pair that no other block has is in no other
block either, so its count is the block's own and it isn't sent. So nothing is sent for a token, only for a block's
distinct words, pairs and triples, no table of all of them is in one place, and shards grow in number with the tokens. A context with very many tokens is dealt over several shards by its words.

Defined cases: a null or empty text is one end token; unknown words have c = 0; without training texts all probability is
the unknown word's; a long text lies in its block whole; rows with equal doc_id are scored each; a null doc_id is not held
out; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import shared, textvec
from cairn.llm.eliasfano import Trie

#: Text bytes of a block, tokens of a shard, tokens of a context in one shard.
BLOCK_BYTES, SHARD_TOKENS, CONTEXT_TOKENS = 8 << 20, 2_000_000, 500_000
#: Stands for the end of a text among word hashes.
END = np.uint64(0x5EED)
DECADES, STEPS = 9.0, 254


def quantise(p: np.ndarray) -> np.ndarray:
    """Bytes from 1 for probabilities above 0."""
    return (1 + np.rint(np.clip(np.log10(np.maximum(p, 1e-300)) / DECADES + 1, 0, 1) * STEPS)).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (((code.astype(float) - 1) / STEPS - 1) * DECADES), 0.0)


def weight(c: np.ndarray) -> np.ndarray:
    """lam of contexts with these counts."""
    return c / (c + 1 + 5 * np.maximum(c, 0.0) ** 0.85)


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    import zstandard

    a = np.ascontiguousarray(a, "<u8")
    planes = a.view(np.uint8).reshape(-1, 8).T
    used = max([k + 1 for k in range(8) if planes[k].any()], default=0)
    return zstandard.compress(bytes([used]) + len(a).to_bytes(8, "little") + planes[:used].tobytes(), 3)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    b = zstandard.decompress(b)
    n = int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, : b[0]] = np.frombuffer(b, np.uint8, offset=9).reshape(b[0], n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def blocks(docs: DataFrame, held: str, key: str, text: str) -> DataFrame:
    """Blocks of docs: their ids, hold-out marks, token counts, distinct word hashes, and tokens as places among them."""

    def run(batches):
        import pyarrow as pa

        def close(rows):
            t = textvec.Texts([r[2] for r in rows])
            count = t.counts() + 1
            end = np.cumsum(count) - 1
            tokens = np.empty(int(count.sum()), np.uint64)
            body = np.ones(len(tokens), bool)
            body[end] = False
            tokens[body], tokens[end] = t.hashes, END
            train = np.repeat([not r[1] for r in rows], count)
            words, place = np.unique(tokens, return_inverse=True)
            seen = np.bincount(place[train], minlength=len(words))
            return pa.RecordBatch.from_pydict(
                {
                    "block": [uuid.uuid4().hex],
                    "ids": pa.array([[r[0] for r in rows]], pa.list_(kind)),
                    "held": pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())),
                    "count": pa.array([count.tolist()], pa.list_(pa.int64())),
                    "tokens": [pack(place)],
                    "words": [pack_sorted(words)],
                    "seen": [pack(seen)],
                    "n_tokens": pa.array([len(tokens)], pa.int64()),
                    "n_train": pa.array([int(seen.sum())], pa.int64()),
                    "n_docs": pa.array([sum(not r[1] for r in rows)], pa.int64()),
                }
            )

        rows, size, kind = [], 0, pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), textvec.as_bytes(b.column(2)), strict=True):
                rows.append((i, h, t))
                size += len(t) + 8
                if size >= BLOCK_BYTES:
                    yield close(rows)
                    rows, size = [], 0
        if rows:
            yield close(rows)

    kind = docs.schema[key].dataType.simpleString()
    spec = f"block string, ids array<{kind}>, held array<boolean>, count array<bigint>, tokens binary, words binary, seen binary, n_tokens long, n_train long, n_docs long"
    core = docs.select(F.col(key).alias("id"), F.coalesce(F.col(held), F.lit(False)).alias("held"), F.col(text).alias("text"))
    return shared.stored(core.mapInArrow(run, spec), "lm-blocks")


def spans(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of each run in rising shard numbers: only shards that have something."""
    if not len(shard):
        return []
    begin = np.flatnonzero(np.diff(shard, prepend=shard[:1] + 1))
    return list(zip(shard[begin].tolist(), begin.tolist(), np.append(begin[1:], len(shard)).tolist(), strict=True))


def shard_of(values: np.ndarray, n: int) -> np.ndarray:
    """The shard of each hash: equal ranges of their upper half."""
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def word_counts(table: DataFrame, n: int) -> DataFrame:
    """For each block and shard, training counts and ids of the block's words there; n_words of each shard on its own rows."""

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for block, w, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, seen = unpack_sorted(w), unpack(s)
                own = spans(shard_of(words, n))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([k for k, _, _ in own], pa.int64()), "block": [block] * len(own), "words": [pack_sorted(words[x:y]) for _, x, y in own], "seen": [pack(seen[x:y]) for _, x, y in own]})

    def answer(group):
        import pyarrow as pa

        shard = group.column("shard")[0].as_py()
        parts = [unpack_sorted(x) for x in group.column("words").to_pylist()]
        seen = np.concatenate([unpack(x) for x in group.column("seen").to_pylist()])
        words, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, seen.astype(float), len(words)).astype(np.uint64)
        at = np.cumsum([0, *map(len, parts)])
        ids = place.astype(np.uint64) * np.uint64(n) + np.uint64(shard) + np.uint64(1)
        parts_at = list(zip(at[:-1], at[1:], strict=True))
        return pa.table(
            {
                "block": pa.array([*group.column("block").to_pylist(), None], pa.string()),
                "shard": pa.array([shard] * (len(parts) + 1), pa.int64()),
                "counts": pa.array([*(pack(total[place[x:y]]) for x, y in parts_at), None], pa.binary()),
                "word_ids": pa.array([*(pack_sorted(ids[x:y]) for x, y in parts_at), None], pa.binary()),
                "n_words": pa.array([*[None] * len(parts), int((total > 0).sum())], pa.int64()),
                "top": pa.array([*[None] * len(parts), len(words) * n + n], pa.int64()),
            }
        )

    sent = table.select("block", "words", "seen").mapInArrow(send, "shard long, block string, words binary, seen binary").repartition(n, "shard")
    return shared.stored(sent.groupBy("shard").applyInArrow(answer, "block string, shard long, counts binary, word_ids binary, n_words long, top long"), "lm-words")


def distinct(v: np.ndarray, w: np.ndarray, with_v: np.ndarray):
    """Distinct pairs (v, w) in order, with_v of theirs, and the place of each given pair among them."""
    top = int(w.max()) + 1 if len(w) else 1
    if not len(v) or int(v.max()) < (1 << 64) // top - 1:
        order = np.argsort(v * np.uint64(top) + w, kind="stable")
    else:
        order = np.lexsort((w, v))
    sv, sw = v[order], w[order]
    new = np.ones(len(order), bool)
    new[1:] = (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return sv[new], sw[new], with_v[order][new], of


class _Block:
    """A block with the counts and ids of its words: its tokens' pairs."""

    def __init__(self, tokens: bytes, count: list[int], answers):
        answers = sorted(answers)
        counts = np.concatenate([unpack(c) for _, c, _ in answers])
        ids = np.concatenate([unpack_sorted(i) for _, _, i in answers])
        place = unpack(tokens).astype(np.int64)
        self.c, self.word = counts[place].astype(np.int64), ids[place]
        self.size = np.array(count, np.int64)
        first = np.cumsum(self.size) - self.size
        self.before = np.roll(self.word, 1)
        self.c_before = np.roll(self.c, 1)
        self.before[first] = 0  # the beginning of a text
        self.start = first

    def pairs(self, n_train_docs: int, n: int):
        """Distinct pairs of known words by shard: shard, context, word, context count, and each token's place (or -1)."""
        self.c_before[self.start] = n_train_docs
        known = np.flatnonzero((self.c > 0) & (self.c_before > 0))
        v, w, cv, of = distinct(self.before[known], self.word[known], self.c_before[known])
        with np.errstate(over="ignore"):
            lots = (cv // CONTEXT_TOKENS + 1).astype(np.uint64)
            shard = (textvec.mix(textvec.mix(v + np.uint64(77)) + w % lots) % np.uint64(n)).astype(np.uint16 if n < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")  # small integers: a radix sort
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.full(len(self.c), -1)
        place[known] = rank[of]
        return shard[order].astype(np.uint64), v[order], w[order], cv[order], place

    def triples(self, place: np.ndarray, codes, n: int):
        """From the pairs' places and answers: shard, pair id, word, count of the pair, and each token's place (or -1), as
        of pairs; triples that are in this block only come last, in shard n. Also each token's pair share and lam of the
        pair before it."""
        codes = sorted(codes)
        join = lambda k, f: np.concatenate([f(x[k]) for x in codes]) if codes else np.zeros(0, np.uint64)
        byte, count, ids = join(1, lambda x: np.frombuffer(x, np.uint8)), join(2, unpack), join(3, unpack_sorted)
        count, alone = (count >> np.uint64(1)).astype(np.int64), (count & np.uint64(1)).astype(bool)
        pair, lam = np.zeros(len(place)), np.zeros(len(place))
        has = place >= 0
        pair[has] = dequantise(byte)[place[has]]
        context = np.roll(place, 1)
        context[self.start] = -1
        has = context >= 0
        lam[has] = weight(count[context[has]].astype(float))
        known = np.flatnonzero((lam > 0) & (pair > 0))
        v, w, token, of = distinct(ids[context[known]], self.word[known], known)
        cv = count[context[token]]
        with np.errstate(over="ignore"):
            lots = (cv // CONTEXT_TOKENS + 1).astype(np.uint64)
            shard = (textvec.mix(textvec.mix(v + np.uint64(99)) + w % lots) % np.uint64(n)).astype(np.int64)
        shard[alone[context[token]] | alone[place[token]]] = n
        order = np.argsort(shard.astype(np.uint16) if n < (1 << 16) - 1 else shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.full(len(place), -1)
        at[known] = rank[of]
        return shard[order].astype(np.uint64), v[order], w[order], cv[order], at, pair, lam


def _cogrouped(left, right) -> _Block:
    return _Block(left.column("tokens")[0].as_py(), left.column("count")[0].as_py(), zip(right.column("shard").to_pylist(), right.column("counts").to_pylist(), right.column("word_ids").to_pylist(), strict=True))


def _seen(block, held, place: np.ndarray, n: int) -> np.ndarray:
    """How often each of n places comes in the block's training texts."""
    train = np.repeat(~np.array(held, bool), block.size)
    return np.bincount(place[train & (place >= 0)], minlength=n)


def _deal(block: str, s, v, w, cv, seen, n: int):
    """Rows for the shards below n, of (context, word) in their order."""
    import pyarrow as pa

    cols = {"shard": [], "contexts": [], "runs": [], "totals": [], "words": [], "seen": []}
    for k, x, y in spans(s[: np.searchsorted(s, np.uint64(n))].astype(np.int64)):
        new = np.ones(y - x, bool)
        new[1:] = v[x + 1 : y] != v[x : y - 1]
        begin = np.flatnonzero(new)
        step = np.diff(w[x:y], prepend=np.uint64(0))
        step[begin] = w[x:y][begin]  # a context's words rise; the first is whole
        cols["shard"].append(k)
        cols["contexts"].append(pack_sorted(v[x:y][begin]))
        cols["runs"].append(pack(np.diff(np.append(begin, y - x))))
        cols["totals"].append(pack(cv[x:y][begin]))
        cols["words"].append(pack(step))
        cols["seen"].append(pack(seen[x:y]))
    return pa.table({"shard": pa.array(cols["shard"], pa.int64()), "block": pa.array([block] * len(cols["shard"]), pa.string()), **{k: pa.array(cols[k], pa.binary()) for k in list(cols)[1:]}})


DEALT = "shard long, block string, contexts binary, runs binary, totals binary, words binary, seen binary"


def _answers(sent: DataFrame, n: int, n_words: int, n_contexts: int | None, last: bool, name: str) -> DataFrame:
    """For each block and shard, a byte for each (context, word) of the block there; unless it is the last level, also
    their counts, with a bit for those that no other block has, and ids; top of each shard, above its ids, on a row of its own."""

    def answer(group):
        import pyarrow as pa

        vs, ws, cs, ts = [], [], [], []
        for c, r, t, w, s in zip(*(group.column(k).to_pylist() for k in ("contexts", "runs", "totals", "words", "seen")), strict=True):
            run, step = unpack(r).astype(np.int64), unpack(w)
            begin = np.cumsum(run) - run
            whole = np.cumsum(step, dtype=np.uint64)
            base = whole[begin] - step[begin]
            vs.append(np.repeat(unpack_sorted(c), run))
            ws.append(whole - np.repeat(base, run))
            ts.append(np.repeat(unpack(t), run))
            cs.append(unpack(s).astype(np.int64))
        v, w, total, seen = map(np.concatenate, (vs, ws, ts, cs))
        sizes = list(map(len, vs))
        del vs, ws, ts, cs
        v, w, total, of = distinct(v, w, total)
        count = np.bincount(of, seen, len(v)).astype(np.int64)
        train = np.flatnonzero(count)  # the trie holds what training texts have
        c = total[train].astype(float)
        trie = Trie(v[train], w[train], quantise(weight(c) * count[train] / np.maximum(c, 1)), n_words, n_contexts)
        try:
            code = trie.lookup(v, w)[of]  # what several blocks ask for is searched once
        finally:
            trie.close()
        at = np.cumsum([0, *sizes])
        parts_at = list(zip(at[:-1], at[1:], strict=True))
        out = {"block": group.column("block").to_pylist(), "shard": group.column("shard").to_pylist(), "codes": [code[x:y].tobytes() for x, y in parts_at]}
        if not last:
            shard = out["shard"][0]
            both = count.astype(np.uint64) * np.uint64(2) + (np.bincount(of, minlength=len(v)) == 1).astype(np.uint64)
            out["counts"] = [pack(both[of[x:y]]) for x, y in parts_at] + [None]
            out["ids"] = [pack_sorted(of[x:y].astype(np.uint64) * np.uint64(n) + np.uint64(shard)) for x, y in parts_at] + [None]
            out["top"] = [None] * len(parts_at) + [len(v) * n + n]
            for k, x in (("block", None), ("shard", shard), ("codes", None)):
                out[k].append(x)
        kinds = {"block": pa.string(), "shard": pa.int64(), "top": pa.int64()}
        return pa.table({k: pa.array(x, kinds.get(k, pa.binary())) for k, x in out.items()})

    spec = "block string, shard long, codes binary" + ("" if last else ", counts binary, ids binary, top long")
    return shared.stored(sent.repartition(n, "shard").groupBy("shard").applyInArrow(answer, spec), name)


def pair_codes(table: DataFrame, words: DataFrame, n: int, tasks: int, n_train_docs: int, n_words: int) -> DataFrame:
    """For each block and shard, a byte, count and id for each of the block's distinct pairs there."""

    def send(left, right):
        b = _cogrouped(left, right)
        s, v, w, cv, place = b.pairs(n_train_docs, n)
        return _deal(left.column("block")[0].as_py(), s, v, w, cv, _seen(b, left.column("held")[0].as_py(), place, len(s)), n)

    core = table.select("block", "held", "count", "tokens").repartition(tasks, "block")
    sent = core.groupBy("block").cogroup(words.select("block", "shard", "counts", "word_ids").repartition(tasks, "block").groupBy("block")).applyInArrow(send, DEALT)
    return _answers(sent, n, n_words, None, False, "lm-pairs")


def _pairs_of(left, right, n_train_docs: int, n: int):
    """The row of a block, the block, and its triples, of its row with its words' answers and of its pairs' answers."""
    import pyarrow as pa
    import pyarrow.compute

    first = left.filter(pa.compute.is_valid(left.column("tokens")))
    b = _cogrouped(first, left.filter(pa.compute.is_valid(left.column("counts"))))
    place = b.pairs(n_train_docs, n)[-1]
    return first, b, b.triples(place, zip(*(right.column(k).to_pylist() for k in ("shard", "codes", "counts", "ids")), strict=True), n)


def triple_codes(both: DataFrame, codes: DataFrame, n: int, tasks: int, n_train_docs: int, n_words: int, n_pairs: int) -> DataFrame:
    """For each block and shard, a byte for each of the block's distinct triples there that other blocks may have."""

    def send(left, right):
        first, b, (s, v, w, cv, at, _, _) = _pairs_of(left, right, n_train_docs, n)
        return _deal(first.column("block")[0].as_py(), s, v, w, cv, _seen(b, first.column("held")[0].as_py(), at, len(s)), n)

    sent = both.groupBy("block").cogroup(codes.repartition(tasks, "block").groupBy("block")).applyInArrow(send, DEALT)
    return _answers(sent, n, n_words, n_pairs, True, "lm-triples")


def score(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (order 1), score (order 3: the whole model) and
    bigram_score (order 2) of every row; `held` names the boolean column of the rows that teach nothing."""
    table = blocks(docs, held, key, text)
    size = table.agg(F.sum("n_tokens").alias("t"), F.sum("n_train").alias("n"), F.sum("n_docs").alias("d"), F.count("*").alias("blocks")).first()
    tokens, train, train_docs = size["t"] or 0, size["n"] or 0, size["d"] or 0
    n, tasks = max(4, -(-tokens // SHARD_TOKENS)), max(1, 2 * size["blocks"])  # as many tasks as there are shards and blocks to deal
    words = word_counts(table, n)
    known = words.where("block is null").agg(F.sum("n_words").alias("v"), F.max("top").alias("top")).first()
    v, top = known["v"] or 0, (known["top"] or 0) + 1
    words = words.where("block is not null").select("block", "shard", "counts", "word_ids")
    both = table.select("block", "ids", "held", "count", "tokens").unionByName(words, allowMissingColumns=True).repartition(tasks, "block")
    codes = pair_codes(table, words, n, tasks, train_docs, top)
    n_pairs = (codes.where("block is null").agg(F.max("top").alias("top")).first()["top"] or 0) + 1
    codes = codes.where("block is not null").drop("top")
    last = triple_codes(both, codes, n, tasks, train_docs, top, n_pairs)
    kind = docs.schema[key].dataType.simpleString()

    def finish(left, right):
        import pyarrow as pa
        import pyarrow.compute

        of_pairs = pa.compute.is_valid(right.column("ids"))
        first, b, (s, _, _, cv, at, pair, lam3) = _pairs_of(left, right.filter(of_pairs), train_docs, n)
        right = right.filter(pa.compute.invert(of_pairs))
        byte = np.frombuffer(b"".join(x for _, x in sorted(zip(right.column("shard").to_pylist(), right.column("codes").to_pylist(), strict=True))), np.uint8)
        own = len(byte)  # from here on the block's own counts are all
        seen, c = _seen(b, first.column("held")[0].as_py(), at, len(s))[own:], cv[own:].astype(float)
        byte = np.concatenate([byte, np.where(seen > 0, quantise(weight(c) * seen / np.maximum(c, 1)), 0).astype(np.uint8)])
        triple = np.zeros(len(at))
        has = at >= 0
        triple[has] = dequantise(byte)[at[has]]
        uni = (b.c + 0.5) / (train + 0.5 * (v + 1))
        lam = weight(b.c_before.astype(float))
        p = np.minimum(pair, lam) + (1 - lam) * uni
        p3 = np.minimum(triple, lam3) + (1 - lam3) * p
        by = lambda x: np.add.reduceat(x, b.start)
        n_docs = len(b.size)
        return pa.table(
            {
                "key": pa.array(first.column("ids")[0].as_py(), first.schema.field("ids").type.value_type),
                "held_out": pa.array(first.column("held")[0].as_py(), pa.bool_()),
                "n_tokens": pa.array(b.size),
                "n_known": pa.array(by((b.c > 0).astype(np.int64))),
                "train_tokens": pa.array([train] * n_docs, pa.int64()),
                "base_score": pa.array(by(np.log10(uni))),
                "score": pa.array(by(np.log10(p3))),
                "bigram_score": pa.array(by(np.log10(p))),
            }
        )

    spec = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bigram_score double"
    replies = codes.select("block", "shard", "codes", "counts", "ids").unionByName(last, allowMissingColumns=True)
    out = both.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(finish, spec)
    return out.withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))
