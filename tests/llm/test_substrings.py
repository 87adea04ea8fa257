import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from cairn.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(rows, width=50):
    big = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for i, t in zip(big, texts):
        for k in range(len(t) - width + 1):
            s = t[k : k + width]
            least[s] = min(least.get(s, i), i)
    out = []
    for (key, _), i, t in zip(rows, big, texts):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < i:
                gone[k + 1 : k + 1 + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((key, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op4_substrings(spark, SF).collect()), key=str) == brute(rows)


def test_cases(spark, monkeypatch):
    rnd = random.Random(9)
    alphabet = "ab é\n"
    pool = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 160))) for _ in range(12)]
    rows = [(rnd.randint(0, 60), "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 5)))) for _ in range(90)]
    rows += [(None, pool[0] * 3), (None, pool[0] * 3), (70, None), (71, ""), (72, "a" * 5000), (73, "a" * 49), (74, "a" * 50), (75, "\0" * 120), (76, "x" + "\0" * 60), (3, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, block int, ids string")
    want = brute(rows)

    def got():
        out = substrings.removed(docs)
        return sorted(map(tuple, queries.substring_digests(out).collect()), key=str)

    assert got() == want
    assert substrings.removed(docs.limit(0)).count() == 0
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 700)  # many blocks
    assert got() == want
    monkeypatch.setattr(substrings, "HOT", 1)  # nearly every anchor is hot: its strings go one by one
    monkeypatch.setattr(substrings, "BATCH", 50)
    assert got() == want


def test_a_hot_anchor(spark, monkeypatch):
    passage = "this passage stands in every document of all sites"
    rows = [(k, f"{k * 7919 % 1000:03d} {'left' * (k % 9)} {passage}{k % 11} and so on, document {k} ends here with words of its own") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    for hot in (10, 1 << 40):
        monkeypatch.setattr(substrings, "HOT", hot)
        assert sorted(map(tuple, queries.substring_digests(substrings.removed(docs)).collect()), key=str) == brute(rows)


def test_masks_have_room_for_every_string(spark):
    docs = spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string")
    with pytest.raises(ValueError):
        substrings.removed(docs, width=100, k=20)


def test_family_like_a_dictionary(monkeypatch):
    for chunk in (1, 7, 1 << 15):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        rnd = np.random.default_rng(1)
        family, least = substrings.Family(3), {}
        for batch in range(40):
            contexts = [bytes(rnd.integers(97, 102, n)) for n in rnd.integers(3, 7, 30)]
            ids = np.sort(rnd.integers(10 * batch, 10 * batch + 9, 30))
            strings = [(c[k : k + 3], i) for c, i in zip(contexts, ids.tolist()) for k in range(len(c) - 2)]
            for key, i in strings:
                least[key] = min(least.get(key, i), i)
            assert family.add(contexts, ids).tolist() == [least[key] for key, _ in strings]
        assert len(family.levels) < 12 and sum(map(len, family.levels)) <= 2 * len(least)
        for level in family.levels:
            keys = level.keys(0, len(level)).tolist()
            assert keys == sorted(set(keys))


def test_masks_in_batches(monkeypatch):
    rnd = random.Random(2)
    contexts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(8, 12))).encode() for _ in range(300)]
    ids = [rnd.randint(0, 50) for _ in contexts]
    want = []
    for c, i in zip(contexts, ids):
        want.append(sum(1 << j for j in range(len(c) - 7) if any(c[j : j + 8] in d and k < i for d, k in zip(contexts, ids))))
    for size in (1, 40, 1 << 16):
        monkeypatch.setattr(substrings, "BATCH", size)
        assert substrings.earlier(contexts, ids, 8) == want
