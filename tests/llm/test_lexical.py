import math
import random
import re
from collections import Counter

import numpy as np

from cairn.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(key, Counter(split(t))) for key, t in docs]
    bags = [(key, b) for key, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for key, b in bags:
            n = sum(b.values())
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(split(text)) if b[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(found, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


def made(rnd, n):
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(40)] + ["Été", "ÉTÉ", "x_y", "a1", "日本"]
    return [(i, " ".join(rnd.choice(words) for _ in range(int(rnd.paretovariate(0.8)) % 300))) for i in range(n)]


def test_like_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    docs = made(rnd, 700)
    docs += [(1000 + i, docs[7][1] or "w1 w2") for i in range(60)]  # copies tie
    docs += [(5, None), (6, ""), (7, "!!"), (None, "w1 w3 x_y"), (8, docs[8][1]), (8, docs[8][1])]
    items = [(i, t) for i, t in made(rnd, 40)] + [(90, None), (91, ""), (92, "nowhere to be found"), (None, "w2 w3"), (93, docs[7][1])]
    have = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = spark.createDataFrame(items, "item_id int, text string")
    expected = brute(docs, items)
    for docs_a_block, group, round_, block in ((4096, 4096, 16, 500_000), (64, 20, 1, 50)):
        monkeypatch.setattr(lexical, "DOCS", docs_a_block)
        monkeypatch.setattr(lexical, "GROUP", group)
        monkeypatch.setattr(lexical, "ROUND", round_)
        got = lexical.search(have, want, block_terms=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == expected


def test_threshold_stops_before_the_lists_end():
    rnd = np.random.default_rng(4)
    n, terms = 4000, 6
    doc, term = np.divmod(np.flatnonzero(rnd.random(n * terms) < 0.5), terms)
    impact = (rnd.random(len(doc)) ** 6 * 900_000).astype(np.int64) + 1
    block = lexical.Block(n, terms, doc, term, impact)
    own, weights = np.arange(terms), np.array([900, 10, 500, 1, 0, 40])
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, impact * weights[term])
    best = np.lexsort((np.arange(n), -full))[:10]
    docs, scores = block.best(own, weights, 10, 0)
    assert docs.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
    assert block.read < len(doc) / 3
    read = block.read
    assert len(block.best(own, weights, 10, int(full.max()) + 1)[0]) == 0
    assert block.read - read < read
    tied = lexical.Block(50, 1, np.arange(50), np.zeros(50, int), np.full(50, 7))
    assert tied.best(np.array([0]), np.array([2]), 10, 14)[0].tolist() == list(range(10))


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 3)
    text = "One two-three été FOUR 5five\x00six" * 30
    assert [w.decode() for part in lexical.terms(text.encode()) for w in part] == [t for t in split(text)]


def test_cases(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), (None, "x", 3)], "name string, body string, score int")
    items = spark.createDataFrame([("q", "X!")], "item string, body string")
    got = lexical.search(docs, items, doc_key="name", item_key="item", text="body")
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [("q", 1, None), ("q", 2, "a"), ("q", 3, "b")]
    assert lexical.search(docs, items.limit(0), doc_key="name", item_key="item", text="body").count() == 0
    assert lexical.search(docs.limit(0), items, doc_key="name", item_key="item", text="body").count() == 0
