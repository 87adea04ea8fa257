import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from cairn.llm import eliasfano, lm, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Scores by dictionaries, without quantisation."""
    toks = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            one.update(t)
            two.update(zip(["<s>", *t], t))
    n, v = sum(one.values()), len(one)
    starts = held.count(False)
    out = []
    for (i, _), t, h in zip(rows, toks, held):
        base = score = 0.0
        for a, b in zip(["<s>", *t], t):
            uni = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            c = starts if a == "<s>" else one[a]
            lam = float(lm.weight(np.array([float(c)]))[0])
            base += math.log10(uni)
            score += math.log10(lam * two[a, b] / max(c, 1) + (1 - lam) * uni)
        out.append((i, h, len(t), sum(one[x] > 0 for x in t), n, base, score))
    return out


def close(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[7] - w[6]) <= 0.02 * w[2] + 1e-9


def test_query_like_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = queries.op2_lm(spark, SF).collect()
    close(got, brute(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["bigram_score"] for r in held) > sum(r["base_score"] for r in held)


def test_cases_and_split_contexts(spark, monkeypatch):
    rows = [(k, "the a the b " * (k % 5) + f"w{k % 7} The") for k in range(60)] + [(None, None), (None, "the"), (61, ""), (3, "twice"), (3, "twice"), (62, "z" * 100_000), (63, "the b " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block int, held_out string").withColumn("h", lm.held_out())
    close(lm.score(docs, "h").collect(), brute(rows))
    assert lm.score(docs.limit(0), "h").count() == 0


def test_probabilities_sum_to_one():
    c = {("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 5}
    one = {"a": 8, "b": 6}
    n, v = sum(one.values()), len(one)
    for ctx, total in (("a", 4), ("b", 5)):
        lam = float(lm.weight(np.array([float(total)]))[0])
        uni = {w: (one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in one} | {"?": 0.5 / (n + 0.5 * (v + 1))}
        assert math.isclose(sum(lam * c.get((ctx, w), 0) / total + (1 - lam) * u for w, u in uni.items()), 1)


def test_rounded_probabilities_nearly_sum_to_one():
    rnd = np.random.default_rng(5)
    for n in (1, 3, 40, 5000):
        seen = rnd.integers(1, 50, n).astype(float)
        total = seen.sum()
        lam = lm.weight(np.array([total]))[0]
        share = np.minimum(lm.dequantise(lm.quantise(lam * seen / total)), lam)
        assert abs(share.sum() + (1 - lam) - 1) <= 0.042 * lam


def test_shards_have_only_what_is_theirs():
    rnd = np.random.default_rng(6)
    for n in (1, 4, 7, 1000):
        v = np.sort(rnd.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
        k = lm.shard_of(v, n)
        assert (np.diff(k) >= 0).all() and k.min() >= 0 and k.max() < n
        assert [(s, x, y) for s, x, y in lm.spans(k) if not (k[x:y] == s).all() or x >= y] == [] and sum(y - x for _, x, y in lm.spans(k)) == len(v)
    assert lm.spans(np.zeros(0, np.int64)) == []


def test_elias_fano_and_trie():
    rnd = np.random.default_rng(2)
    for n, u in ((0, 5), (1, 1), (1, 10**12), (500, 600), (3000, 10**9), (4000, 5000)):
        a = np.sort(rnd.integers(0, u, n, dtype=np.uint64))
        e = eliasfano.EliasFano(a, u)
        if n:
            assert (e.access(np.arange(n)) == a).all()
        q = np.concatenate([a, rnd.integers(0, u, 500, dtype=np.uint64)])
        assert (e.successor(q) == np.searchsorted(a, q)).all()
        assert ((e.find(q) >= 0) == np.isin(q, a)).all()
    pairs = np.unique(rnd.integers(0, 400, (5000, 2)), axis=0)
    codes = rnd.integers(1, 256, len(pairs))
    trie = eliasfano.Trie(pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64), codes, 500)
    known = {tuple(p): c for p, c in zip(pairs.tolist(), codes.tolist())}
    q = rnd.integers(0, 500, (8000, 2))
    assert trie.lookup(q[:, 0].astype(np.uint64), q[:, 1].astype(np.uint64)).tolist() == [known.get(tuple(x), 0) for x in q.tolist()]
    p = 10 ** -rnd.uniform(0, 9, 1000)
    assert (np.abs(np.log10(lm.dequantise(lm.quantise(p)) / p)) < 0.018).all()
    for a in (rnd.integers(0, 1 << 62, 100, dtype=np.uint64), np.zeros(0, np.uint64), np.arange(70_000, dtype=np.uint64)):
        assert (lm.unpack(lm.pack(a)) == a).all() and (lm.unpack_sorted(lm.pack_sorted(np.sort(a))) == np.sort(a)).all()


def brute_trigram(rows):
    """Scores of order 3 by dictionaries, without quantisation."""
    toks = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    grams = [Counter() for _ in range(4)]
    for t, h in zip(toks, held):
        for k in range(len(t)) if not h else ():
            for m in range(1, 4):
                if k + 2 > m - 1:
                    grams[m][tuple(["<s>", *t][max(0, k + 2 - m) : k + 2])] += m < 3 or k > 0
    n, v = sum(grams[1].values()), len(grams[1])
    grams[1][("<s>",)] = held.count(False)
    out = []
    for (i, _), t in zip(rows, toks):
        score = 0.0
        for k in range(len(t)):
            p = ((grams[1][(t[k],)] if t[k] != "<s>" else 0) + 0.5) / (n + 0.5 * (v + 1))
            for m in (2, 3) if k else (2,):
                gram = tuple(["<s>", *t][k + 2 - m : k + 2])
                c = grams[m - 1][gram[:-1]]
                lam = float(lm.weight(np.array([float(c)]))[0])
                p = lam * grams[m][gram] / max(c, 1) + (1 - lam) * p
            score += math.log10(p)
        out.append((i, len(t), score))
    return out


def test_score_like_brute_force(spark, monkeypatch):
    table = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    cases = [(k, "the a the b " * (k % 5) + f"w{k % 7} a the The x{k}") for k in range(60)] + [(None, None), (None, "the"), (61, ""), (64, "the b " * 3000)]
    for rows, block in ((table, lm.BLOCK_BYTES), (table, 20_000), (cases, lm.BLOCK_BYTES), (cases, 200)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", lm.held_out())
        found = lm.score(docs, "h").collect()
        got = sorted([(r["doc_id"], r["n_tokens"], r["score"]) for r in found], key=str)
        want = sorted(brute_trigram(rows), key=str)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) <= 0.02 * w[1] + 1e-9
        if rows is table:
            assert sum(r["score"] for r in found if r["held_out"]) > sum(r["bigram_score"] for r in found if r["held_out"])
