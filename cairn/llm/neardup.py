"""Near-duplicate documents by SetSketch registers, banding, joint likelihood estimates and exact verification.

Register i of a set is the largest floor(1 - log_b(x)) over its elements' exponential values x for hash i, cut to 16
bits: an exponentially spaced truncated minimum. Registers of a union are the larger of each pair (`merge`). Sets whose
registers agree in a whole band are candidates; the likelihood of how many registers are larger, smaller and equal gives
their Jaccard similarity given both sizes (`estimate`); those that may reach the threshold are verified on full sets.

Equal sets are one node. The nodes of a bucket meet under the bucket's least node, its leader, and a node is sent once
to each of its leaders, however many bands they share. Under a leader, a node is first compared with the leader; pairs
of which one isn't linked to it are estimated and verified, unless the triangle inequality of the Jaccard distance rules
them out. Nothing is emitted but links. A leader with more than `chunk` shingles under it is dealt out in chunks: each
gets the leader's set, and the nodes left over then meet all chunks. Components come from contracting the links.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; with fewer words than a shingle
the whole sequence is the shingle; rows with equal doc_id and set share their result; a null doc_id is never a component's
id, and a set held only by rows with null doc_ids has none and is linked with nothing; n_shingles counts the whole set whatever its length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import shared, textvec

BASE, RATE = 1.001, 20.0
BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: Candidates whose estimate is this many standard errors below the threshold are not verified.
SLACK = 4.0
CHUNK = 4_000_000
SALTS = 16

_rng = np.random.default_rng(97)
_MUL = _rng.integers(0, 1 << 31, M, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of M registers for each non-empty set."""
    out = np.empty((len(sets), M), np.uint16)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 16):
            size += len(sets[to])
            to += 1
        low = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:to]])])[:-1]
        least = np.empty((to - at, M), np.uint32)
        for i in range(M):
            least[:, i] = np.minimum.reduceat(low * _MUL[i] + _ADD[i], begin)
        x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        out[at:to] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 65535).astype(np.uint16)
        at = to
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of one sketch with each of many, the sets' sizes being known."""
    up = (one > many).sum(1)[:, None]
    down = (one < many).sum(1)[:, None]
    u = (n / (n + sizes))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 101)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0)
        like = part(up, a) + part(down, b) + part(M - up - down, 1 - a - b)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _node(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Links:
    """Links among the nodes of one task."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / M)

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
        both = common(a, b)
        union = len(a) + len(b) - both
        return both / union, 100 * both >= self.percent * union

    def find(self, regs: np.ndarray, sets: list[np.ndarray], first: list[int], rest: range, leader: int | None):
        """Links between `first` and `rest`; yields index pairs. With a leader, everything is compared with it first
        and what it links needs no more pairs. Also yields (index, None) for nodes the leader doesn't link."""
        sizes = np.array([len(s) for s in sets])
        root = list(range(len(sets)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        away = np.zeros(len(sets))  # distance from the leader, exact
        loose = first
        if leader is not None:
            others = [i for i in range(len(sets)) if i != leader]
            loose = []
            for i in others:
                j, linked = self.jaccard(sets[leader], sets[i])
                away[i] = 1 - j
                if linked:
                    root[top(i)] = top(leader)
                    yield leader, i
                else:
                    loose.append(i)
                    yield i, None
        lo, hi = rest.start, rest.stop
        done: set[int] = set()
        far = 1 - self.percent / 100 + 1e-9
        for u in loose:
            done.add(u)
            ok = (100 * np.minimum(sizes[lo:hi], sizes[u]) >= self.percent * np.maximum(sizes[lo:hi], sizes[u])) & (np.abs(away[lo:hi] - away[u]) <= far if leader is not None else True)
            near = np.flatnonzero(ok & ((regs[lo:hi] == regs[u]).sum(1) >= 0.8 * self.least * M)) + lo if ok.any() else ()
            near = np.array([v for v in near if v != u and v not in done and v != leader], int)
            if not len(near):
                continue
            guess = estimate(regs[u], int(sizes[u]), regs[near], sizes[near])
            for v, g in zip(near.tolist(), guess, strict=True):
                if g >= self.least and top(u) != top(v) and self.jaccard(sets[u], sets[v])[1]:
                    root[top(u)] = top(v)
                    yield u, v


def sketch(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set) and registers of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                t = textvec.Texts(textvec.as_bytes(part.column(1)))
                sets = [textvec.shingle_set(t.hashes[x:y], width) for x, y in zip(t.first[:-1], t.first[1:], strict=True)]
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = dict(zip(full, registers([sets[i] for i in full]), strict=True)) if full else {}
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), pa.array([regs[i].tobytes() if i in regs else None for i in range(len(sets))], pa.binary())],
                    ["doc_id", "n_shingles", "node", "regs"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, regs binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (rep, node, regs, jobs: array of (leader, chunk, role)) with the sets of its nodes, a row for each job."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                t = textvec.Texts(textvec.as_bytes(part.column("text")))
                sets = [textvec.shingle_set(t.hashes[x:y], width) for x, y in zip(t.first[:-1], t.first[1:], strict=True)]
                # rows of another text under the same id are not the node's
                own = [i for i, n in enumerate(part.column("node").to_pylist()) if _node(sets[i]) == n]
                jobs = part.column("jobs").to_pylist()
                at = [i for i in own for _ in jobs[i]]
                flat = [j for i in own for j in jobs[i]]
                if flat:
                    take = lambda c: pc.take(part.column(c), pa.array(at, pa.int64()))  # noqa: B023, E731
                    packed = {i: sets[i].tobytes() for i in own}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([j["leader"] for j in flat], pa.binary()), pa.array([j["chunk"] for j in flat], pa.string()), pa.array([j["role"] for j in flat], pa.int32()), take("node"), take("regs"), pa.array([packed[i] for i in at], pa.binary())],
                        ["leader", "chunk", "role", "node", "regs", "set"],
                    )

    core = docs.select(F.col("doc_id").alias("rep"), "text").where("text is not null")
    return core.join(wanted.hint("shuffle_hash"), "rep").select("text", "node", "regs", "jobs").mapInArrow(run, "leader binary, chunk string, role int, node binary, regs binary, set binary")


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) under each (leader, chunk); b is null for a node that the leader of a dealt-out group leaves over.

    Roles: 0 the leader, 1 a node, 2 a node left over that meets the rows of role 1."""

    def run(table):
        import pyarrow as pa

        role = np.array(table.column("role").to_pylist())
        order = np.argsort(role, kind="stable")
        nodes = table.column("node").to_pylist()
        raw, sets = table.column("regs").to_pylist(), table.column("set").to_pylist()
        # a node whose rows came twice under one role counts once
        seen: set[tuple] = set()
        order = [i for i in order.tolist() if not ((int(role[i]), nodes[i]) in seen or seen.add((int(role[i]), nodes[i])))]
        nodes, role = [nodes[i] for i in order], role[order]
        regs = np.stack([np.frombuffer(raw[i], np.uint16) for i in order])
        sets = [np.frombuffer(sets[i], np.uint64) for i in order]
        links = Links(percent)
        if role[-1] == 2:
            cut = int((role == 1).sum())
            found = links.find(regs, sets, list(range(cut, len(nodes))), range(0, cut), None)
        else:
            found = links.find(regs, sets, [], range(0, len(nodes)), 0 if role[0] == 0 else None)
        whole = table.column("chunk")[0].as_py() == "0/1"
        pairs = [(nodes[a], nodes[b] if b is not None else None) for a, b in found if b is not None or not whole]
        leader = table.column("leader")[0].as_py()
        return pa.table({"leader": pa.array([leader] * len(pairs), pa.binary()), "a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return rows.groupBy("leader", "chunk").applyInArrow(run, "leader binary, a binary, b binary")


def links(docs: DataFrame, sketches: DataFrame, percent: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """Verified links (a, b) between nodes that connect whatever is similar."""
    nodes = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n"))
    # without an id a node's set can't be fetched, so it must not lead a bucket either
    nodes = nodes.where("rep is not null")
    nodes = shared.stored(nodes, "neardup-nodes")
    band = lambda i: F.xxhash64(F.lit(i), F.substring(F.col("regs"), 2 * ROWS * i + 1, 2 * ROWS))
    bands = nodes.select("node", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key")).repartition("key")
    buckets = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("leader")).where("c > 1").select("key", "leader")
    under = bands.join(buckets, "key").select("leader", "node").distinct()
    under = shared.stored(under.join(nodes.select("node", "n"), "node"), "neardup-under")
    size = under.groupBy("leader").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("parts"))

    def jobs(rows: DataFrame) -> DataFrame:
        """The rows (node, leader, chunk, role) by node, with what a node is sent with."""
        by = rows.groupBy("node").agg(F.collect_set(F.struct("leader", "chunk", "role")).alias("jobs"))
        return by.join(nodes.select("node", "rep", "regs"), "node")

    name = lambda c: F.concat_ws("/", c.cast("string"), F.col("parts").cast("string"))
    dealt = under.join(size, "leader").withColumn("c", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")))
    plain = dealt.where("node != leader").select("node", "leader", name(F.col("c")).alias("chunk"), F.lit(1).alias("role"))
    heads = size.select(F.col("leader").alias("node"), "leader", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c")).select("node", "leader", name(F.col("c")).alias("chunk"), F.lit(0).alias("role"))
    found = shared.stored(_linked(_sets(docs, jobs(plain.unionByName(heads)), width), percent), "neardup-links")
    out = found.where("b is not null").select("a", "b")
    left = found.where("b is null").select(F.col("a").alias("node"), "leader")
    if left.limit(1).count():  # groups in several chunks only
        spread = left.groupBy("leader").agg(F.count("*").alias("k")).select("leader", F.ceil(F.col("k") / 256).cast("int").alias("lots"))
        lot = F.pmod(F.xxhash64(F.lit("lot"), F.col("node")), F.col("lots").cast("long"))
        tag = F.concat_ws("-", F.lit("left"), F.col("lot").cast("string"), F.col("c").cast("string")).alias("chunk")
        those = left.join(spread, "leader").join(size, "leader").select("node", "leader", lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c")).select("node", "leader", tag, F.lit(2).alias("role"))
        against = dealt.where("node != leader").join(spread, "leader").select("node", "leader", "c", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")).select("node", "leader", tag, F.lit(1).alias("role"))
        more = shared.stored(_linked(_sets(docs, jobs(those.unionByName(against)), width), percent), "neardup-more")
        out = out.unionByName(more.where("b is not null").select("a", "b"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node with a link, by contraction: each round a node moves to its least neighbour."""
    edges = shared.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "components-edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while edges.limit(1).count():
        move = edges.select(F.col("b").alias("x"), F.col("a").alias("y")).union(edges.select("a", "b")).groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        move = shared.stored(move, "components-move")
        labels = shared.stored(labels.join(move, labels["root"] == move["x"], "left").select("node", F.coalesce("to", "root").alias("root")), "components-labels")
        step = edges.join(move.select(F.col("x").alias("a"), F.col("to").alias("p")), "a").join(move.select(F.col("x").alias("b"), F.col("to").alias("q")), "b")
        edges = shared.stored(step.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a != b").distinct(), "components-edges")
    return labels


def _members(docs: DataFrame, percent: int, width: int, chunk: int) -> DataFrame:
    """doc_id, n_shingles, node, root (the same for all nodes of a class; null for an empty set) and component_id of every row."""
    docs = docs.select("doc_id", "text")
    rows = shared.stored(sketch(docs, width), "neardup-sketch")
    groups = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    root = components(links(docs, rows, percent, width, chunk))
    member = groups.join(root, "node", "left")
    least = member.where("root is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
    known = member.join(least, "root", "left").where("copies > 1 or root is not null").select("node", "root", F.coalesce("component_id", "rep").alias("component_id"))
    # a set with very many copies is dealt over SALTS tasks
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.select("doc_id", "n_shingles", "node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(known, ["node", "salt"], "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, percent: int = 80, width: int = 5, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    out = _members(docs, percent, width, chunk).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _with_nodes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text, row (all columns of docs) and node of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                t = textvec.Texts(textvec.as_bytes(part.column(1)))
                sets = [textvec.shingle_set(t.hashes[x:y], width) for x, y in zip(t.first[:-1], t.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_node(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "text", "row", "node"])

    core = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return core.mapInArrow(run, T.StructType([*core.schema.fields, T.StructField("node", T.BinaryType())]))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """The rows of docs, all columns, that stay: of each class the document with the smallest doc_id, once if it is
    repeated; of rows with that doc_id but unequal texts, the least text. Rows without words are a class with those of
    equal doc_id and text. Rows with a null doc_id can't be told apart and stay."""
    found = _members(docs, percent, width, CHUNK).where("doc_id is not null").groupBy("doc_id", "node", "root", "component_id").agg(F.count("*").alias("rows"))
    found = shared.stored(found, "neardup-classes")
    gone = found.where("doc_id != component_id").select("doc_id")
    twice = found.groupBy("doc_id").agg(F.sum("rows").alias("n")).where("n > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not twice.limit(1).count():
        return left
    # rows of a repeated doc_id are told apart by their sets
    some = _with_nodes(docs.join(twice, "doc_id", "left_semi").select(*docs.columns), width)
    own = found.where("doc_id = component_id").select(F.col("doc_id").alias("d"), F.col("node").alias("x"), "root")
    some = some.join(own, (F.col("doc_id") == F.col("d")) & F.col("node").eqNullSafe(F.col("x")))
    some = some.groupBy("doc_id", "root", F.when(F.col("root").isNull(), F.col("text"))).agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(some.select("row.*"))
