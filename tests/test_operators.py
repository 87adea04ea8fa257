"""Small cases with known values."""

import datetime as dt
import json
import math
import re

import pytest

from cairn.functions import code, text
from cairn.operators import audit, briefs, graph, mining, retrieval
from cairn.plans import fixture
from cairn.session import parts
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def touch(spark):
    commits = {"01": "ab", "02": "abc", "03": "ab", "04": "ac", "05": "ab"}
    data = [(c, f, c) for c, fs in commits.items() for f in fs] + [("07", f"x{k}", "07") for k in range(16)] + [("01", "a", "01")]
    return spark.createDataFrame(data, "basket string, item string, ts string")


def test_co_change_caps_baskets_and_keeps_own_time(touch):
    assert rows(mining.co_change(touch)) == [("a", "b", 4, "05")]
    both = mining.virtual_edges(mining.co_change(touch), mining.item_totals(touch), min_support=4)
    assert rows(both) == [("a", "b", 1.0, 1.0, 4)]
    assert rows(mining.symbol_co_change(touch, max_items=15)) == [("a", "b", 4, 5, 0.8, "05"), ("b", "a", 4, 4, 1.0, "05")]


def test_given_partitions_hold_and_change_no_pair(touch):
    made = mining.baskets(touch, 15, 5)
    assert made.rdd.getNumPartitions() == 5  # adaptive plans leave one where nothing is asked for
    assert rows(made) == rows(mining.baskets(touch, 15))
    assert rows(mining.co_change(touch, partitions=5)) == rows(mining.co_change(touch))
    assert rows(mining.symbol_co_change(touch, max_items=15, partitions=5)) == rows(mining.symbol_co_change(touch, max_items=15))
    spread = touch.repartition(5, "basket")
    plan = mining.baskets(spread, 15, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_touches_take_more_partitions_as_lines_grow(spark, monkeypatch):
    assert parts(spark.range(100), rows=2) == 50
    counts = []
    for n in (11, 22):
        monkeypatch.setattr(fixture, "parts", lambda df, n=n: n)
        counts.append(fixture.touch(spark, "/root/testdata/sf0.001", "l_suppkey").rdd.getNumPartitions())
    assert counts == [11, 22]


def test_hotspots_keep_ties(spark):
    n = dict(a=50, b=30, c=30, h=30, d=12, e=9, i=7, j=6, k=6, f=5, g=4)
    got = mining.hotspots(spark.createDataFrame(list(n.items()), "item string, freq long"))
    assert rows(got) == [("a", 50, 1.0), ("b", 30, 0.6), ("c", 30, 0.6), ("h", 30, 0.6)]
    assert mining.hotspots(spark.createDataFrame([], "item string, freq long")).count() == 0


@pytest.mark.parametrize("authors, hours, want", [("AAA", (0, 40, 60), [2, 1]), ("ABA", (0, 1, 2), [1, 1, 1]), ("AA", (0, 48), [2])])
def test_macro_change_is_anchored(spark, authors, hours, want):
    base = dt.datetime(2024, 5, 1)
    # the order of events is by time over all authors of a file
    e = spark.createDataFrame([("f", a, base - dt.timedelta(hours=h)) for a, h in zip(authors, hours)], "key string, author string, ts timestamp_ntz")
    got = sorted(mining.macro_change(e).collect(), key=lambda r: r["group"])
    assert [r["n"] for r in got] == want and all(r["first_ts"] <= r["last_ts"] for r in got)


def test_overlap_across_bins(spark):
    h = spark.createDataFrame([("f", 5, 5000), ("f", 999, 1000), ("g", 1, 1)], "file string, start long, end long")
    s = spark.createDataFrame([("f", "x", 1, 6), ("f", "y", 990, 3000), ("f", "z", 6000, 7000)], "file string, symbol string, start long, end long")
    assert rows(mining.overlap_counts(h, s)) == [("f", "x", 1), ("f", "y", 2)]


def test_scores(spark):
    one = spark.range(1)
    got = one.select(*text.amnesia_risk(F.lit(20), F.lit(0))).first()
    assert tuple(got) == (0.45843, 0.687644, 0.484527, 0.890762)
    cases = [((0.9, True, 1, 0), 1.0), ((0.9, True, 2, 0), 0.95), ((0.7, False, 3, 1), 0.43), ((0.5, False, 12, 0), 0.25), ((0.5, False, 4, 3), 0.05)]
    for args, want in cases:
        assert one.select(text.path_risk(*map(F.lit, args))).first()[0] == want
    assert one.select(text.fingerprint(F.array(F.lit("view.py"), F.lit("handler.py")))).first()[0] == "8101cec8b2f7f4ae346b93c75f58d4d690df9af28e41b78efa18db19bf7ab4de"


def test_scorecards(spark):
    hot = spark.createDataFrame([("auth.py", 0.82)], "item string, risk double")
    edges = spark.createDataFrame([("auth.py", "user.py", 0.8)], "item_a string, item_b string, rate double")
    n = spark.createDataFrame([(1,)], "n long")
    assert rows(audit.health_score(hot, edges.withColumn("item_b", F.lit("auth.py")), n)) == [(86.5, "A")]
    counts = spark.createDataFrame([(1, 1, 1, 1, True, 1)], "links long, hot long, edges long, prompts long, has_ai boolean, hitl long")
    dora = audit.dora_score(counts).first()
    assert (dora["score"], dora["tier"], dora["governance_status"]) == (81.0, "B", "PARTIAL")
    assert audit.ai_act_score(counts.withColumn("links", F.lit(0)).withColumn("hot", F.lit(0))).first()["score"] == 70.0


def test_rank_fusion(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "id string, rank int")
    b = spark.createDataFrame([("q", 1), ("p", 2), ("s", 3)], "id string, rank int")
    got = {k: v for k, v in rows(retrieval.rrf_fusion(a, b))}
    for k, v in dict(p=0.01628768, q=0.0162348, r=0.00952381, s=0.00634921).items():
        assert math.isclose(got[k], v, abs_tol=1e-8)


def test_taint_paths(spark):
    e = spark.createDataFrame([("v", "h"), ("v", "m"), ("m", "h"), ("h", "h"), ("x", "y")], "src string, dst string")
    n = lambda s: spark.createDataFrame([(c,) for c in s], "node string")
    assert rows(graph.taint_paths(e, n("vxh"), n("h"))) == [("h", "h", 1, "h"), ("v", "h", 2, "v>h")]


def test_taint_paths_have_no_depth_bound(spark):
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(7)] + [("7", "0")], "src string, dst string")
    n = lambda s: spark.createDataFrame([(c,) for c in s], "node string")
    assert rows(graph.taint_paths(e, n("0"), n("7"))) == [("0", "7", 8, "0>1>2>3>4>5>6>7")]
    assert graph.taint_paths(e, n("0"), n("7"), depth=4).count() == 0


def test_retrospective_points(spark):
    schema = "item string, type string, signal_class string, relevance double, at timestamp, links int"
    at = lambda y: dt.datetime(y, 1, 1)
    warn = "pre_cve_warning"
    data = [("a", "amnesia", None, None, None, k) for k in (0, 0, 0, None, 3)]
    data += [("a", warn, "semantic", r, t, None) for r, t in ((1.0, at(2020)), (None, at(2022)), (0.5, None))] + [("a", warn, "awareness", None, None, None)] * 4
    data += [("a", "architectural_decision", None, None, None, None)] * 2 + [("a", "intent_impl_delta", None, None, None, None)]
    data += [("b", warn, "semantic", 0.5, at(2010), None), ("b", warn, "semantic", 0.5, at(2020), None)]
    blast = spark.createDataFrame([("a", 30), ("b", 15), ("c", 4)], "item string, n long")
    # a: 30 + 12 + 14 + 9 + 10 + 10 + 8; b: 7 + 7, its two dates lie too far apart
    assert rows(briefs.retrospective(spark.createDataFrame(data, schema), blast)) == [("a", 93, "ALERT"), ("b", 14, "PASS"), ("c", 0, "PASS")]


def test_files_of_a_task(spark):
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(briefs.target_files(F.col("t"))).first()[0]
    assert one("fix ./core/a.rs, src\\B.PY and x.tsx; see django.db.models.deletion, core/a.rs, a.b.py") == ["core/a.rs", "src/B.PY", "x.tsx", "a.b.py", "django/db/models/deletion.py"]
    assert one("nothing here") == []


def test_commit_links_leave_boilerplate_out(spark):
    c = spark.createDataFrame([("abc123456789", "Fixed validation logic in fields.py clean method because of edge case", ["f.py", "b.py"])], "ref string, body string, files array<string>")
    s = spark.createDataFrame([("f.py", "__init__"), ("f.py", "clean"), ("b.py", "__init__"), ("b.py", "save")], "file string, symbol string")
    assert [r[:3] for r in rows(audit.commit_links(c, s, ["fix"]))] == [("clean", "f.py", "abc12345"), ("save", "b.py", "abc12345")]


def test_untested_files_are_cut_first(spark):
    names = [("a.py", 9), ("test_a.py", 9), ("b.py", 1), ("scripts/c.py", 9), ("d.py", 5), ("e/f.py", 6), ("g.py", 7), ("h.py", 8), ("i.py", 9)]
    f = spark.createDataFrame(names, "name string, symbols long")
    assert rows(audit.test_gap(f)) == [("d.py", 5), ("e/f.py", 6), ("g.py", 7), ("h.py", 8)]


def test_links_by_id_or_name(spark):
    links = spark.createDataFrame([(1, "x"), (None, "b"), (9, "a")], "symbol_id long, symbol_name string")
    symbols = spark.createDataFrame([(1, "a", "f"), (2, "b", "f"), (3, "b", "g")], "id long, name string, file string")
    assert [r[2:] for r in rows(audit.disjunctive_links(links, symbols))] == [(1, "a", "f"), (2, "b", "f"), (3, "b", "g")] or audit.disjunctive_links(links, symbols).count() == 3
    wanted = spark.createDataFrame([("r", 100), ("r", 5000)], "repo string, at long")
    cached = spark.createDataFrame([("r", 90, "c1"), ("r", 99, "c2"), ("r", 101, "c3")], "repo string, at long, commit string")
    assert rows(audit.nearest_cached(wanted, cached)) == [("r", 100, "c2")]


def test_mentions_find_their_symbol(spark):
    symbols = spark.createDataFrame([("f", "C", "class", 1, 50), ("f", "m", "method", 10, 20), ("f", "n", "function", 60, 70)], "file string, symbol string, kind string, start long, end long")
    lines = [(9, "m"), (15, "m"), (30, "C"), (56, "n"), (90, "f"), (59, "n")]
    mentions = spark.createDataFrame([("f", k) for k, _ in lines] + [("g", 1)], "file string, line long")
    assert {(r["file"], r["line"]): r["symbol"] for r in audit.mention_targets(mentions, symbols).collect()} == {("f", k): s for k, s in lines} | {("g", 1): "g"}


def test_budget_is_greedy(spark):
    r = spark.createDataFrame([("g", "a", 9.0, 50), ("g", "b", 8.0, 60), ("g", "c", 7.0, 30), ("g", "d", 6.0, 5), ("h", "a", 1.0, 500)], "group string, id string, score double, tokens long")
    assert [(x[0], x[1]) for x in rows(retrieval.within_budget(r, 120))] == [("g", "a"), ("g", "b"), ("g", "d"), ("h", "a")]


def test_comments(spark):
    source = "# gone\n# ADR-7 stays\nx = 1  # gone\ny = 2  # noqa\n\n\n\nz = 3\n"
    got = spark.createDataFrame([(source,)], "c string").select(text.prune_comments(F.col("c"))).first()[0]
    assert got == "# ADR-7 stays\nx = 1\ny = 2  # noqa\n\nz = 3"
    tabs = spark.createDataFrame([("if x:\n\t# gone\n\ty = 1\t  # gone\n\t\n",)], "c string").select(text.prune_comments(F.col("c"))).first()[0]
    assert tabs == "if x:\n\ty = 1"
    ts = "// gone\na()  // gone\n// nocheck"
    assert spark.createDataFrame([(ts,)], "c string").select(text.prune_comments(F.col("c"), "//")).first()[0] == "a()\n// nocheck"


def test_python_sources():
    flows = code.taint("v.py", "def f(request):\n    q = request.GET['x']\n    if q:\n        c = q\n    else:\n        c = 1\n    eval(c)\n\ndef g(a):\n    a = 1\n    eval(a)\n\ndef h(p):\n    try:\n        s = p\n    except E:\n        s = ''\n    os.system(s)\n")
    assert flows == [("v.py", "f", "c", "eval", 7), ("v.py", "h", "s", "system", 18)]
    found = code.symbols("m.py", "class A:\n    def m(self):\n        return helper()\n\ndef helper():\n    return open('f').read()\n")
    assert [(s[1], s[2], s[6]) for s in found] == [("A", "class", False), ("helper", "function", True), ("m", "method", False)]
    assert code.symbols("x", "def (:") == [] and code.skeleton("def f(x: int) -> int:\n    'doc'\n    return x") == "def f(x: int) -> int:\n    \"\"\"doc\"\"\"\n    ..."


def test_sources(spark, tmp_path):
    from cairn.sources import history

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("x = 1\ny = 2\n")
    for name in ("a.min.js", "b.txt"):
        (tmp_path / "pkg" / name).write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("no")
    got = history.source_tree(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["lines"]) for r in got] == [("a.py", 2)]
    log = "abc1234|Ann|2024-05-01 10:00:00 +0200|fix: it | now\n\nbody line\n--END--\ndef5678|Bob|2024-05-02 10:00:00 +0000|next\n--END--\n"
    got = rows(history.git_log(spark.createDataFrame([(log,)], "value string")).select("hash", "author", "subject"))
    assert got == [("abc1234", "Ann", "fix: it | now"), ("def5678", "Bob", "next")]
    names = "abc1234|2024-05-01\na.py\nb.py\n\ndef5678|2024-05-02\nc.py\n"
    assert rows(history.name_only(spark.createDataFrame([(names,)], "value string")).select("commit", "at", "file")) == [("abc1234", "2024-05-01", "a.py"), ("abc1234", "2024-05-01", "b.py"), ("def5678", "2024-05-02", "c.py")]
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,3 @@\n keep\n-old\n+new\n+more\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b".split("\n")
    lines = spark.createDataFrame([("d", k, s) for k, s in enumerate(diff)], "diff string, n int, text string")
    assert rows(history.unified_diff(lines).select("file", "sign", "text", "new_line")) == [("x.py", "+", "more", 5), ("x.py", "+", "new", 4), ("x.py", "-", "old", 3), ("y.py", "+", "b", 1), ("y.py", "-", "a", 0)]
    docs = spark.createDataFrame([("a.md", "short\n\n" + "p" * 60 + "\n \n" + "q" * 51)], "path string, text string")
    assert [(r[1], len(r[2])) for r in rows(history.decision_docs(docs))] == [(0, 60), (1, 51)]
    talk = spark.createDataFrame([("c", k, "u", f"m{k}", None if k % 2 else "bot") for k in range(50)], "channel string, ts int, user string, text string, bot_id string")
    assert sorted(r["text"].count("\n") + 1 for r in history.chat_chunks(talk).collect()) == [5, 20]
    chat = spark.createDataFrame([("s1", "p", 1, "a"), ("s2", "p", 2, "b"), ("s2", "p", 3, "c"), ("s3", "q", 9, "d")], "sessionId string, project string, timestamp long, display string")
    assert rows(history.last_session(chat, "p")) == [(1, "b"), (2, "c")]
    finding = spark.createDataFrame([("fragile", "a.py", 0, "hi")], "rule string, file string, line int, message string")
    assert json.loads(history.sarif(finding).first()[0])["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_stream_upserts_once(spark, tmp_path):
    from cairn.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    schema = "path string, at long, n long"

    def feed(name, *events):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("path", "at", "n"), e))) for e in events))
        ingest.stream_ingest(spark, str(source), schema, str(tmp_path / "out"), str(tmp_path / "check"), ["path"], ["at"], buckets=4).awaitTermination()

    feed("1.json", ("a", 1, 10), ("b", 1, 20), ("a", 2, 11))
    feed("2.json", ("b", 5, 21), ("c", 1, 30))
    feed("3.json", ("b", 4, 0), ("d", 1, 40))
    feed("4.json", ("b", 6, 22))
    assert rows(ingest.read_latest(spark, str(tmp_path / "out"), schema)) == [("a", 2, 11), ("b", 6, 22), ("c", 1, 30), ("d", 1, 40)]
    assert all(len(v) <= 2 for v in ingest._versions(spark, str(tmp_path / "out")).values())


def test_conventions():
    from cairn.functions import conventions

    go = "func PutA(x *T) {\n if x == nil { return }\n}\nfunc PutB(x *T) {\n if x != nil { go() }\n}\nfunc PutC(x *T) { go() }\n"
    assert conventions.guards("a.go", go) == [("a.go", "PutA", "put", True), ("a.go", "PutB", "put", True), ("a.go", "PutC", "put", False)]
    assert conventions.guards("a.ts", "function f(x) { if (!x) return; }") == [("a.ts", "f", "f", True)]
    assert conventions.assets("b.py", "from openai import x\nmy_prompt = 1\nconfirm(2)\n") == [("b.py", "framework", "openai"), ("b.py", "gate", "confirm"), ("b.py", "prompt", "my_prompt")]
    assert conventions.apply_diff("a\nb\nc\nd", "@@ -2,1 +2,2 @@\n-b\n+B\n+BB\n@@ -4 +5 @@\n-d\n+D") == "a\nB\nBB\nc\nD"


def test_patched_and_unguarded(spark):
    from cairn.functions import conventions

    f = spark.createDataFrame([("a", "x\ny", "@@ -1 +1 @@\n-x\n+z")], "path string, code string, diff string")
    assert rows(conventions.patched(f)) == [("a", "z\ny")]
    code_ = "".join(f"def get_{k}(x):\n    assert isinstance(x, int)\n" for k in "abc") + "def get_d(x):\n    pass\n"
    assert rows(conventions.unguarded(spark.createDataFrame([("m.py", code_)], "path string, code string"))) == [("m.py", "get_d")]


def test_bm25_splits_odd_texts_once(spark):
    texts = ["", "!", "a", " a ", "a b!", "!a", "A-a_1 b", "c " * 9, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = {k: re.findall("[a-z0-9_]+", t.lower()) for k, t in enumerate(texts) if t is not None}
    n, avg = len(lists), sum(map(len, lists.values())) / len(lists)
    want = {}
    for term in ("a", "b"):
        df = sum(term in w for w in lists.values())
        for k, w in lists.items():
            if tf := w.count(term):
                want[k] = want.get(k, 0) + math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    best = retrieval.bm25(docs, "a, B")
    assert {r["doc_id"]: r["score"] for r in best.collect()} == {k: pytest.approx(s, abs=2e-6) for k, s in want.items()}
    assert "split" not in best._jdf.queryExecution().optimizedPlan().toString()
