import re

import pyarrow.parquet as pq

from cairn.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}, len(w)


def brute(docs, items):
    out = set()
    for key, text in items:
        n = shingles(text, 1)[1]
        if not n:
            continue
        own = shingles(text, min(5, n))[0]
        for d, t in docs:
            found = len(own & shingles(t, min(5, n))[0])
            if 10 * found >= 8 * len(own):
                out.add((d, key, len(own), found))
    return out


def test_like_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {tuple(r)[:4] for r in queries.op1_decontaminate(spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, text), (2, "Alpha BETA"), (3, None), (4, ""), (5, text), (6, "solo")]
    filler = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, f"{filler} {text} {filler}"), (1, f"{filler} {text} {filler}"), (2, "x one two three four five six seven eight nine ten eleven ten y"), (3, "one two three four five"), (4, None), (5, ""), (6, "an alpha beta"), (None, "solo")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item long, n_found int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 3):
        got = decontaminate.search(docs, bench, block_shingles=size)
        assert {tuple(r)[:4] for r in got.collect()} == brute(rows, items)
        assert sum(r["doc_id"] == 1 for r in got.collect()) == 4
        kept = decontaminate.keep_clean(docs, bench, block_shingles=size)
        hit = {d for d, *_ in brute(rows, items)}
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in hit) and kept.columns == docs.columns
    assert decontaminate.search(docs.limit(0), bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "other")], "doc_id int, TEXT string")
    for kind, ids in (("long", [None, 7]), ("int", [3, None]), ("string", ["a", None])):
        bench = spark.createDataFrame([(i, "One two three four five six") for i in ids], f"item_id {kind}, text string")
        got = decontaminate.search(docs, bench)
        assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str) == sorted([(1, i) for i in ids], key=str)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [2]
