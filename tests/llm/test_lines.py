from collections import defaultdict

import pyarrow.parquet as pq

from cairn.llm import lines, queries

SF = "/root/testdata/sf0.01"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for x in (t or "").split("\n") if t is not None else ():
            if x.strip(" "):
                sites[x] |= {s} - {None}
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    gone = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for d, t, _ in rows:
        all_lines = [] if t is None else t.split("\n")
        kept = [x for x in all_lines if x not in gone or (d is not None and d == first.get(x))]
        out.append((d, None if t is None else "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = queries.op7_line_spread(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cases(spark):
    rows = [(k, f"own {k}\nshared by many\n\n  \nshared by two", f"s{k % 7}") for k in range(1, 40)]
    rows += [(None, "shared by many\nx", "s1"), (99, None, "s2"), (98, "", "s3"), (97, "shared by many", None), (5, rows[4][1], "s5"), (96, "shared by many\n" * 3000 + "end", "s4")]
    docs = spark.createDataFrame([(d, t, s, 7, "z", 3) for d, t, s in rows], "doc_id long, text string, source string, n_lines int, _th string, a int")
    for least in (2, 5, 7, 8):
        got = lines.dedup(docs, least)
        assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == brute(rows, least)
    assert got.columns == ["doc_id", "text", "source", "_th", "a", "n_lines", "n_removed"]
    assert lines.dedup(docs.limit(0)).count() == 0


def test_large_spread_is_exact_near_the_threshold(spark):
    rows = [(k, "\n".join(f"line {n}" for n in (950, 1000, 1050) if k < n), f"s{k}") for k in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.dedup(docs, 1000, lg_k=8)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == brute(rows, 1000)


def test_a_document_that_loses_most_of_its_lines_and_one_without_counts(spark):
    many = [f"common line {k}" for k in range(800)]
    rows = [(d, "\n".join([f"own {d}", *many, "", "end"]), f"site {d}") for d in range(12)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, n_lines int, pos string")
    got = lines.dedup(docs)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == brute(rows, 10)
    plain = lines.dedup(docs, counts=False)
    assert plain.columns == docs.columns and all(r["n_lines"] == 7 and r["pos"] == "x" for r in plain.collect())
    assert {r["doc_id"]: r["text"] for r in plain.collect()} == {r[0]: r[1] for r in brute(rows, 10)}


def test_counts_exactly_near_the_threshold(spark):
    for least in (2, 10):
        rows = [(s * 100 + k, f"line of {n} sites", f"site {s}") for n in range(1, 2 * least + 3) for s in range(n) for k in range(2)]
        rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=least)
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == brute(rows, least)
