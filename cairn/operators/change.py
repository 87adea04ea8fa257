"""The check of changes before they are merged: nine kinds of findings for every change set at once, suppression by
feedback, and the exit policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.audit import is_trivial

# Places and suffixes of documents and of others' code, suffixes of tested sources.
DOC_DIRS, DOC_SUFFIXES = ("docs/", "doc/"), (".txt", ".rst", ".md")
OTHER_DIRS = ("docs/", "doc/", "examples/", "vendor/", "node_modules/", "venv/", ".venv/")
TESTED = (".py", ".ts", ".go", ".js", ".java")
COLUMNS = "change kind severity file symbol other score note".split()


def _starts(path: Column, prefixes: tuple[str, ...]) -> Column:
    return path.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    return path.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def _finding(rows: DataFrame, kind: str, severity: str | Column, **given: Column) -> DataFrame:
    """Rows (change, file, ...) as findings; what isn't given is null."""
    empty = {"symbol": "string", "other": "string", "score": "double", "note": "string"}
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("change", F.lit(kind).alias("kind"), severity.alias("severity"), "file", *(given[c].cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in empty.items()))


def hotspot_findings(changed: DataFrame, hotspots: DataFrame, files: DataFrame, links: DataFrame, risk: float = 0.5, freq: int = 10, forgotten: int = 15) -> DataFrame:
    """Changed files that are hotspots(file, freq, risk), documents aside: a warning where no link(file) explains one of at
    least `forgotten` changes that isn't trivial by files(file, lines), else a note. other is the number of links."""
    live = hotspots.where((F.col("risk") >= risk) & (F.col("freq") >= freq) & ~_starts(F.col("file"), DOC_DIRS) & ~_ends(F.col("file"), DOC_SUFFIXES))
    live = live.join(links.groupBy("file").agg(F.count("*").alias("n")), "file", "left").join(files.select("file", "lines"), "file", "left")
    trivial = is_trivial(F.lower("file"), F.when(F.col("lines") > 0, F.col("lines")).otherwise(1_000_000))
    n = F.coalesce("n", F.lit(0))
    severity = F.when((n == 0) & (F.col("freq") >= forgotten) & ~trivial, "warning").otherwise("note")
    return _finding(changed.join(live, "file"), "hotspot", severity, other=n, score=F.col("risk"))


def missing_partners(changed: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """pairs(file, other, score[, symbol, note]) whose file is in a change and whose other isn't."""
    met = changed.join(pairs, "file")
    gone = met.join(changed.select("change", F.col("file").alias("other")), ["change", "other"], "left_anti")
    return _finding(gone, kind, "warning", other=F.col("other"), score=F.col("score"), **{c: F.col(c) for c in ("symbol", "note") if c in pairs.columns})


def both_ways(edges: DataFrame, rate: float = 0.7, support: int = 4) -> DataFrame:
    """edges(item_a, item_b, rate, support) → file, other, score in both directions."""
    strong = edges.where((F.col("rate") >= rate) & (F.col("support") >= support))
    one = lambda a, b: strong.select(F.col(a).alias("file"), F.col(b).alias("other"), F.col("rate").alias("score"))
    return one("item_a", "item_b").unionByName(one("item_b", "item_a")).distinct()


def untested(changed: DataFrame) -> DataFrame:
    """Changes with sources and without tests; file is the first of the sources, other their number."""
    test = F.lower("file").contains("test")
    source = _ends(F.col("file"), TESTED) & ~test & ~_starts(F.col("file"), OTHER_DIRS)
    rows = changed.groupBy("change").agg(F.min(F.when(source, F.col("file"))).alias("file"), F.count(F.when(source, 1)).alias("n"), F.count(F.when(test, 1)).alias("tests"))
    return _finding(rows.where("n > 0 AND tests = 0"), "test_coupling", "warning", other=F.col("n"))


def fragile(changed: DataFrame, scores: DataFrame, least: int = 2, per_file: int = 5) -> DataFrame:
    """The most often mended symbols of changed files, from scores(file, symbol, score)."""
    by = Window.partitionBy("file").orderBy(F.desc("score"), "symbol")
    top = scores.where(F.col("score") >= least).withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_file)
    return _finding(changed.join(top, "file"), "fragile", "warning", symbol=F.col("symbol"), score=F.col("score"))


def suppressed(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """findings without those that feedback(finding_type, file, symbol) dismisses: invariant and co_change findings by
    their file (an empty symbol), sibling findings by file and symbol; the type `all` fits each of the three."""
    key = F.when(F.col("kind") == "sibling", F.coalesce("symbol", F.lit(""))).when(F.col("kind").isin("invariant", "co_change"), "")
    rows = findings.withColumn("_key", key)
    marks = feedback.select(F.col("finding_type").alias("_type"), "file", F.coalesce("symbol", F.lit("")).alias("_key")).distinct()
    every = marks.where("_type = 'all'").select("file", "_key")
    typed = marks.where("_type != 'all'").select(F.col("_type").alias("kind"), "file", "_key")
    return rows.join(every, ["file", "_key"], "left_anti").join(typed, ["kind", "file", "_key"], "left_anti").select(*COLUMNS)


def change_check(changed: DataFrame, *, hotspots: DataFrame, files: DataFrame, links: DataFrame, edges: DataFrame, rules: DataFrame, siblings: DataFrame, guards: DataFrame, boundaries: DataFrame, fragility: DataFrame, feedback: DataFrame) -> DataFrame:
    """changed(change, file) → change, kind, severity, file, symbol, other, score, note.

    hotspots(file, freq, risk), files(file, lines), links(file, symbol, source_type, ref), edges(item_a, item_b, rate,
    support), rules(symbol_a, file_a, symbol_b, file_b, shared, confidence), siblings(file, symbol), guards(change, file,
    guard), boundaries(change, file, old_op, new_op), fragility(file, symbol, score), feedback(finding_type, file, symbol).
    Each input is read once and joined by file; a change's file counts once however often it is listed."""
    changed = changed.select("change", "file").where("file IS NOT NULL").distinct()
    paired = rules.where("confidence >= 0.5 AND shared >= 3").select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), F.col("confidence").alias("score"), F.col("symbol_a").alias("symbol"), F.col("symbol_b").alias("note"))
    own = lambda rows: rows.join(changed, ["change", "file"], "left_semi")
    ref = F.when(F.col("source_type") == "commit", F.substring("ref", 1, 8)).otherwise(F.col("ref"))
    parts = [
        hotspot_findings(changed, hotspots, files, links),
        missing_partners(changed, "co_change", both_ways(edges)),
        missing_partners(changed, "rule", paired),
        untested(changed),
        _finding(changed.join(siblings.select("file", "symbol").distinct(), "file"), "sibling", "warning", symbol=F.col("symbol")),
        _finding(own(guards), "invariant", "critical", note=F.col("guard")),
        _finding(own(boundaries), "boundary", "note", note=F.concat_ws(" -> ", "old_op", "new_op")),
        fragile(changed, fragility),
        _finding(changed.join(links, "file"), "link", "note", symbol=F.col("symbol"), other=F.col("source_type"), note=ref),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return suppressed(found, feedback)


def gate(changed: DataFrame, findings: DataFrame, fail_on: str = "critical") -> DataFrame:
    """change, critical, warnings, failed: whether a change is let through. `critical` fails on removed guards, `warning`
    also on siblings, missing partners and missing tests, anything else never. Changes without findings pass."""
    warns = F.col("kind").isin("sibling", "co_change", "rule", "test_coupling")
    counted = findings.where((F.col("kind") == "invariant") | warns)  # the plan then leaves out the other kinds' joins
    n = counted.groupBy("change").agg(F.count(F.when(F.col("kind") == "invariant", 1)).alias("critical"), F.count(F.when(warns, 1)).alias("warnings"))
    rows = changed.select("change").distinct().join(n, "change", "left").select("change", F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    failed = {"critical": F.col("critical") > 0, "warning": (F.col("critical") > 0) | (F.col("warnings") > 0)}.get(fail_on, F.lit(False))
    return rows.withColumn("failed", failed)
