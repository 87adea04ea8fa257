"""The change check, its gate, consolidation and stream tables with known values."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import change
from cairn.streaming import ingest


@pytest.fixture(scope="module")
def given(spark):
    make = spark.createDataFrame
    return {
        "hotspots": make([("a.py", 20, 0.9), ("b.py", 12, 0.6), ("docs/c.py", 50, 1.0), ("c.md", 50, 1.0), ("x/version.py", 30, 0.8), ("short.py", 30, 0.8), ("cold.py", 9, 0.9)], "file string, freq int, risk double"),
        "files": make([("short.py", 49), ("a.py", 0)], "file string, lines int"),
        "links": make([("b.py", "g", "commit", "0123456789"), ("b.py", "g", "adr", "adr/long-name.md")], "file string, symbol string, source_type string, ref string"),
        "edges": make([("a.py", "z.py", 0.7, 4), ("y.py", "a.py", 0.9, 9), ("a.py", "b.py", 1.0, 9), ("a.py", "w.py", 0.69, 9), ("a.py", "v.py", 0.9, 3)], "item_a string, item_b string, rate double, support int"),
        "rules": make([("f", "a.py", "h", "q.py", 3, 0.5), ("f", "a.py", "h", "r.py", 2, 0.9), ("f", "q.py", "h", "a.py", 9, 0.9)], "symbol_a string, file_a string, symbol_b string, file_b string, shared int, confidence double"),
        "siblings": make([("a.py", "s"), ("a.py", "t"), ("k.py", "u")], "file string, symbol string"),
        "guards": make([(1, "a.py", "assert x"), (1, "b.py", "assert y"), (2, "zz.py", "assert z")], "change int, file string, guard string"),
        "boundaries": make([(1, "a.py", "<", "<=")], "change int, file string, old_op string, new_op string"),
        "fragility": make([("a.py", f"m{k}", k) for k in range(9)], "file string, symbol string, score int"),
        "feedback": make([("all", "b.py", ""), ("sibling", "a.py", "t"), ("co_change", "nothing", "")], "finding_type string, file string, symbol string"),
    }


def test_change_check_and_gate(spark, given):
    changed = spark.createDataFrame([(1, f) for f in ("a.py", "a.py", "b.py", "docs/c.py", "c.md", "x/version.py", "short.py", "cold.py", None)] + [(2, "t/test_a.py"), (3, "k.py"), (3, "x_test.go"), (4, "README")], "change int, file string")
    found = change.change_check(changed, **given)
    got = {(r["change"], r["kind"], r["severity"], r["file"], r["symbol"] or r["other"] or r["note"]) for r in found.collect()}
    assert got == {
        (1, "hotspot", "warning", "a.py", "0"), (1, "hotspot", "note", "b.py", "2"), (1, "hotspot", "note", "x/version.py", "0"), (1, "hotspot", "note", "short.py", "0"),
        (1, "co_change", "warning", "a.py", "z.py"), (1, "co_change", "warning", "a.py", "y.py"), (1, "rule", "warning", "a.py", "f"), (1, "test_coupling", "warning", "a.py", "5"),
        (1, "sibling", "warning", "a.py", "s"), (3, "sibling", "warning", "k.py", "u"), (1, "invariant", "critical", "a.py", "assert x"), (1, "boundary", "note", "a.py", "< -> <="),
        *((1, "fragile", "warning", "a.py", f"m{k}") for k in range(4, 9)), (1, "link", "note", "b.py", "g"),
    }
    assert {r["note"] for r in found.where("kind = 'link'").collect()} == {"01234567", "adr/long-name.md"}
    gates = {fail: {r["change"]: r["failed"] for r in change.gate(changed, found, fail).collect()} for fail in ("critical", "warning", "none")}
    assert gates == {"critical": {1: True, 2: False, 3: False, 4: False}, "warning": {1: True, 2: False, 3: True, 4: False}, "none": dict.fromkeys((1, 2, 3, 4), False)}
    assert change.change_check(changed.limit(0), **given).count() == 0


def test_the_gate_joins_only_what_it_counts(spark, given):
    changed = spark.createDataFrame([(1, "a.py")], "change int, file string")
    plan = change.gate(changed, change.change_check(changed, **given), "warning")._jdf.queryExecution().optimizedPlan().toString()
    assert "sibling" in plan and not any(f" {kind} AS kind" in plan for kind in ("hotspot", "boundary", "fragile", "link"))
    assert "risk" not in plan


def test_consolidation(spark):
    intents = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", None), ("d", 0.9), ("e", 0.9)], "file string, score double")
    activity = spark.createDataFrame([("a", "2024-03-30", 2), ("a", "2024-03-02", 1), ("b", "2024-03-30", 1), ("c", "2024-03-20", 4), ("d", "2024-02-01", 9), ("e", "2024-03-30", 1)], "file string, at string, commits int").withColumn("at", F.to_timestamp("at"))
    judged = spark.createDataFrame([("a", 0.79, False), ("b", 0.45, True), ("c", 0.62, None), ("d", 0.1, False)], "file string, score double, weakening boolean")
    history, alerts, after = ingest.consolidate(intents, activity, judged, "2024-03-31 00:00:00")
    assert {tuple(r) for r in history.collect()} == {("a", 0.79, 2, 3), ("b", 0.45, 1, 1), ("c", 0.62, 1, 4)}
    assert {tuple(r) for r in alerts.collect()} == {("a", 1.0, 0.79, 21.0), ("b", 0.5, 0.45, 10.0)}
    assert {tuple(r) for r in after.collect()} == {("a", 0.79), ("b", 0.5), ("c", None), ("d", 0.9), ("e", 0.9)}


def test_stream_tables_keep_their_buckets_and_drop_empty_versions(spark, tmp_path):
    schema = "path string, n int, at int"
    (tmp_path / "in").mkdir()

    def feed(name, rows, buckets):
        (tmp_path / "in" / name).write_text("".join(f'{{"path": "{p}", "n": {n}, "at": {a}}}\n' for p, n, a in rows))
        ingest.stream_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), ["path"], ["at"], buckets=buckets).awaitTermination()

    for k in range(5):
        feed(f"{k}.json", [("a", k, k)], 2)
    assert [tuple(r) for r in ingest.read_latest(spark, str(tmp_path / "out"), schema).collect()] == [("a", 4, 4)]
    assert len(list((tmp_path / "out").glob("v=*"))) == 2
    with pytest.raises(ValueError):
        feed("9.json", [("a", 9, 9)], 4)


def test_webhook_events(spark):
    rows = [("closed", (True,), None), ("closed", (False,), None), ("opened", (True,), None), (None, None, ("message", None)), (None, None, ("message", "b1")), (None, None, None)]
    events = spark.createDataFrame(rows, "action string, pull_request struct<merged: boolean>, event struct<type: string, bot_id: string>")
    assert ingest.merged_events(events).count() == 2
