import itertools
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from cairn.llm import quality, queries

SF = "/root/testdata/sf0.01"


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_statistics_and_labels(spark):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {k: brute(t) for k, t in docs.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    passed = [k for k in labels if k in got and not got[k]["base_failed"]]
    assert np.mean([got[k]["kept"] for k in passed if labels[k] == 1]) > 0.97
    assert np.mean([got[k]["kept"] for k in passed if labels[k] == 0]) < 0.1


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(3)
    for n in range(1, 9):
        chain = quality.Chain(np.zeros(quality.N_BITS), 0.0, rnd.normal(size=(2, 2)), 0.5)
        e = rnd.normal(size=n)
        value = lambda p, e=e, c=chain: sum(x for x, y in zip(e, p) if y) + sum(c.moves[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(chain.viterbi(e).astype(int)) == best


def test_gradient_is_that_of_the_likelihood():
    rnd = np.random.default_rng(4)
    sets = [rnd.integers(0, quality.N_BITS, (n, len(quality.EDGES))).astype(np.int16) for n in (1, 3, 4)]
    lab = [rnd.integers(0, 2, len(s)) for s in sets]
    w = rnd.normal(size=quality.N_BITS + 5)

    def loglik(w):
        c = quality.Chain(w[: quality.N_BITS], w[quality.N_BITS], w[quality.N_BITS + 1 :].reshape(2, 2), 0)
        out = 0
        for s, y in zip(sets, lab):
            e = c.emissions(s)
            value = lambda p, e=e: sum(x for x, k in zip(e, p) if k) + sum(c.moves[a, b] for a, b in zip(p, p[1:]))
            out += value(y) - np.logaddexp.reduce([value(p) for p in itertools.product((0, 1), repeat=len(y))])
        return out

    g = quality._loglik_grad(sets, lab, w, np.ones(3))
    for k in [0, 7, quality.N_BITS, *range(quality.N_BITS + 1, len(w))]:
        d = np.zeros(len(w))
        d[k] = 1e-5
        assert abs((loglik(w + d) - loglik(w - d)) / 2e-5 - g[k]) < 1e-4


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n \n\t"), (4, "word " * 100_000), (5, "a b c d\n" * 3), (None, "x"), (5, "a b c d\n" * 3)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.assess(docs, quality.train(docs, labels)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *brute(t or "")) for i, t in rows), key=str)
    assert quality.assess(docs.limit(0), None).count() == 0
