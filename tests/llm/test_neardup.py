import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from cairn.llm import neardup, queries, textvec

SF = "/root/testdata/sf0.001"


def brute(rows, percent, width):
    sets = []
    for _, t in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i)), d == low.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_like_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op5_near_dup(spark, SF).collect()), key=str) == brute(rows, 80, 2)


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(25):
            own = base[:]
            for _ in range(rnd.choice([0, 1, 4, 7, 10, 14])):
                own[rnd.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, rows[3][1]), (3, rows[3][1]), (n + 6, "w " * 50_000)]


def test_groups_of_near_copies_also_in_chunks(spark, copies):
    docs = spark.createDataFrame([(*r, 1, "k") for r in copies], "doc_id long, text string, node int, component_id string")
    want = brute(copies, 80, 2)
    for chunk in (neardup.CHUNK, 700):
        assert sorted(map(tuple, neardup.classes(docs, 80, 2, chunk).collect()), key=str) == want
    assert neardup.classes(docs.limit(0)).count() == 0
    kept = neardup.keep_one(docs, 80, 2)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[3]}


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(8)
    universe = textvec.mix(np.arange(1, 60_001, dtype=np.uint64))
    for j in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            rnd.shuffle(universe)
            n = 1000
            both = int(2 * n * j / (1 + j))
            a, b = np.sort(universe[:n]), np.sort(universe[n - both : 2 * n - both])
            ra, rb = neardup.registers([a, b])
            assert (neardup.merge(ra, rb) == neardup.registers([np.union1d(a, b)])[0]).all()
            errors.append(neardup.estimate(ra, n, rb[None], np.array([n]))[0] - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (200, 200)]
    key = lambda k: f"{(k * 7919) % 1009:04d}".encode()
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(edges).collect()}
    assert {got[key(k)] for k in range(61)} == {min(map(key, range(61)))} and {got[key(k)] for k in (100, 101, 102)} == {min(map(key, (100, 101, 102)))}


def test_null_id_copy_with_the_least_hash(spark):
    rnd = random.Random(11)
    for _ in range(1000):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(2000)]
        texts = [" ".join(base), " ".join([*base[:100], "other", *base[101:]]), " ".join([*base[:1500], "another", *base[1501:]])]
        sets = [textvec.shingle_set(textvec.Texts([t.encode()]).hashes, 2) for t in texts]
        null, a, b = neardup.registers(sets).reshape(3, neardup.BANDS, neardup.ROWS)
        shared = (a == b).all(1)
        if neardup._node(sets[0]) == min(map(neardup._node, sets)) and shared.any() and (null == a).all(1)[shared].all():
            break
    else:
        pytest.fail("no such texts")
    docs = spark.createDataFrame(list(zip((None, 1, 2), texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.classes(docs, 80, 2).collect()} == {None: None, 1: 1, 2: 1}
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(docs, 80, 2).collect()) == [0, 1]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rnd = random.Random(3)
    a, b, c, d = ([f"w{rnd.randrange(10**6)}" for _ in range(300)] for _ in range(4))
    near = lambda t, k: " ".join([*t[:150], f"other{k}", *t[151:]])
    a, (b, c, d) = " ".join(a), ((" ".join(t), t) for t in (b, c, d))
    rows = [(1, a), (5, a), (5, b[0]), (7, c[0]), (7, near(c[1], 1)), (7, d[0]), (8, near(c[1], 2)), (9, near(d[1], 3)), (10, None), (10, None), (10, ""), (None, a), (None, None)]
    docs = spark.createDataFrame([(*r, k, "r") for k, r in enumerate(rows)], "doc_id long, text string, node int, row string")
    kept = neardup.keep_one(docs, 80, 2)
    assert kept.columns == docs.columns
    want = [(1, a), (5, b[0]), (7, min(c[0], near(c[1], 1))), (7, d[0]), (10, None), (10, ""), (None, a), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
