"""Audits: findings, suppression, compound risk, scorecards, links from history to code, verdicts on patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Symbol names that say nothing, unless the commit names them; basenames of trivial files.
BOILERPLATE = (
    "__init__", "__str__", "__repr__", "__eq__", "__hash__", "__iter__", "__len__", "__getitem__", "__setitem__", "__delitem__",
    "setUp", "tearDown", "setUpTestData", "handle", "render", "check", "add_arguments", "deconstruct", "get_queryset", "clean",
)
TRIVIAL = ("__init__.py", "constants.py", "types.ts", "types.py", "settings.py", "version.py")
MENTION = r"(?i)(?:ADR-\d+|decision:\S+|DO\s+NOT\s+(?:MODIFY|TOUCH|CALL|DELETE|REMOVE)|HOTSPOT)"


def is_trivial(path: Column, lines: Column, least: int = 50) -> Column:
    """Whether a file is trivial: by its name, or with fewer than `least` lines."""
    return F.element_at(F.split(path, "/"), -1).isin(*TRIVIAL) | (lines < least)


def amnesia(hot: DataFrame, links: DataFrame, min_freq: int = 15) -> DataFrame:
    """hotspots(item, freq, risk) that are frequent and that no link(item) explains."""
    return hot.where(F.col("freq") >= min_freq).join(links.select("item"), "item", "left_anti")


def suppress(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """findings(finding_type, key, ...) without those that feedback(finding_type, key) dismisses; type `all` fits any."""
    exact = feedback.where("finding_type != 'all'").select("finding_type", "key").distinct()
    every = feedback.where("finding_type = 'all'").select("key").distinct()
    return findings.join(exact, ["finding_type", "key"], "left_anti").join(every, "key", "left_anti").select(*findings.columns)


def pr_check(changed: DataFrame, hot: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """changed(item) → kind, src, dst, score: hotspots that change, and partners by edge or rule that don't.

    edges(item_a, item_b, rate) count in both directions; rules(src, dst, confidence) in theirs."""
    changed = changed.distinct()
    hits = hot.join(changed, "item", "left_semi").select(F.lit("hotspot").alias("kind"), F.col("item").alias("src"), F.lit(None).cast(changed.schema["item"].dataType).alias("dst"), F.col("risk").alias("score"))
    ways = edges.select(F.col("item_a").alias("src"), F.col("item_b").alias("dst"), "rate").unionByName(edges.select(F.col("item_b").alias("src"), F.col("item_a").alias("dst"), "rate")).distinct()

    def partners(kind: str, rows: DataFrame, score: str) -> DataFrame:
        here = rows.join(changed.select(F.col("item").alias("src")), "src", "left_semi")
        return here.join(changed.select(F.col("item").alias("dst")), "dst", "left_anti").select(F.lit(kind).alias("kind"), "src", "dst", F.col(score).alias("score"))

    return hits.unionByName(partners("edge", ways, "rate")).unionByName(partners("rule", rules, "confidence"))


def compound_risk(findings: DataFrame, least: int = 2) -> DataFrame:
    """findings(category, item) → items in several categories."""
    rows = findings.select("category", "item").distinct().groupBy("item").agg(F.count("*").alias("n_categories"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    return rows.where(F.col("n_categories") >= least)


def _tier(score: Column, a: float, b: float) -> Column:
    return F.when(score >= a, "A").when(score >= b, "B").otherwise("C")


def health_score(hot: DataFrame, edges: DataFrame, n_links: DataFrame) -> DataFrame:
    """score and grade from the ten riskiest hotspots(item, risk), edges(item_a, item_b, rate) among them with a rate of
    0.7 or more, and n_links(n)."""
    top = hot.orderBy(F.desc("risk"), "item").limit(10)
    names = top.select(F.col("item"))
    inner = edges.where("rate >= 0.7").join(F.broadcast(names.withColumnRenamed("item", "item_a")), "item_a", "left_semi").join(F.broadcast(names.withColumnRenamed("item", "item_b")), "item_b", "left_semi").agg(F.count("*").alias("e"))
    risk = top.agg(F.coalesce(F.round(F.avg("risk"), 2), F.lit(0.0)).alias("r"))
    raw = 100 - 25 * F.col("r") - F.least(F.lit(15), 3 * F.col("e"))
    score = F.round(F.greatest(F.lit(10.0), F.least(F.lit(100.0), raw + F.when(F.col("n") > 0, 10).otherwise(0))), 1)
    grade = F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C").otherwise("D")
    return risk.crossJoin(inner).crossJoin(n_links).select(score.alias("score")).withColumn("grade", grade)  # one row each


def dora_score(counts: DataFrame) -> DataFrame:
    """counts(links, hot, edges), one row → three article scores, their sum and tier."""
    a = F.lit(15.0) + F.least(F.lit(20.0), 5.0 * F.col("links"))
    b = F.lit(35.0) - F.least(F.lit(20.0), 4.0 * F.col("hot"))
    c = F.lit(15.0) + F.when(F.col("edges") > 0, 15.0).otherwise(0.0)
    ok = lambda x: F.when(x >= 25, "COMPLIANT").otherwise("PARTIAL")
    total = F.round(a + b + c, 1)
    return counts.select(a.alias("governance"), b.alias("resilience"), c.alias("third_party"), total.alias("score"), _tier(total, 85, 65).alias("tier"), ok(a).alias("governance_status"), ok(b).alias("resilience_status"), ok(c).alias("third_party_status"))


def ai_act_score(counts: DataFrame) -> DataFrame:
    """counts(links, hot, prompts, has_ai, hitl), one row → the five article scores, their sum and tier."""
    some = F.col("links") > 0
    risk = F.lit(15.0) + F.when(some, F.least(F.lit(10.0), 2.0 * F.col("links"))).otherwise(0.0) - F.least(F.lit(10.0), 3.0 * F.col("hot"))
    docs = F.lit(10.0) + F.when(some, 10.0).otherwise(0.0) + F.when((F.col("prompts") > 0) | F.col("has_ai"), 5.0).otherwise(0.0)
    human = F.lit(5.0) + F.when((F.col("hitl") > 0) | ~F.col("has_ai"), 10.0).otherwise(0.0)
    total = F.round(risk + 15.0 + docs + 10.0 + human, 1)
    return counts.select(risk.alias("article_9"), F.lit(15.0).alias("article_10"), docs.alias("article_11"), F.lit(10.0).alias("article_12"), human.alias("article_14"), total.alias("score"), _tier(total, 85, 65).alias("tier"))


def commit_links(commits: DataFrame, symbols: DataFrame, keywords: list[str], cap: int = 5000, most_files: int = 3) -> DataFrame:
    """commits(ref, body, files), symbols(file, symbol) → symbol, file, ref, confidence, description.

    A commit that names a reason is linked with the symbols of its files (the file itself if it has none); with many files,
    only those whose name its body has; a boilerplate symbol needs its name in the body. Refs are cut to eight
    characters. The cap keeps the first by ref, file and symbol."""
    low = F.lower(F.col("body"))
    kw = F.filter(F.array(*map(F.lit, keywords)), lambda x: F.contains(low, x))
    rows = commits.withColumn("k", F.size(kw)).where("k > 0").select("ref", "body", "k", F.size("files").alias("n"), F.explode(F.array_distinct("files")).alias("file"))
    rows = rows.where((F.col("n") <= most_files) | F.contains(F.lower("body"), F.lower(F.element_at(F.split("file", "/"), -1))))
    linked = rows.join(symbols.select("file", "symbol"), "file", "left")
    bare = F.col("symbol").isin(*BOILERPLATE) & ~F.contains(F.lower("body"), F.lower("symbol"))
    linked = linked.where(~F.coalesce(bare, F.lit(False))).withColumn("ref", F.substring("ref", 1, 8))
    out = linked.select(
        F.coalesce("symbol", "file").alias("symbol"), "file", "ref", F.round(F.least(F.lit(1.0), 0.6 + 0.1 * F.col("k")), 6).alias("confidence"), F.substring(F.element_at(F.split("body", "\n"), 1), 1, 120).alias("description")
    )
    return out.orderBy("ref", "file", "symbol").limit(cap)


def scoped_context(links: DataFrame, keys: DataFrame, k: int = 10) -> DataFrame:
    """links of the wanted keys(file), the k most confident of each; of a symbol's links with one ref the most confident, of
    equals the first by description."""
    by = Window.partitionBy("file").orderBy(F.desc("confidence"), "ref", "symbol")
    one = Window.partitionBy("file", "symbol", "ref").orderBy(F.desc("confidence"), *(c for c in links.columns if c not in ("file", "symbol", "ref", "confidence")))
    rows = links.join(keys.select("file").distinct(), "file", "left_semi").withColumn("k", F.row_number().over(one)).where("k = 1")
    return rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= k).select(*links.columns)


def test_gap(files: DataFrame, least: int = 5, k: int = 5) -> DataFrame:
    """files(name: path, symbols) → file, n: of the first k files that no test file is named after, those with at least
    `least` symbols. A path with `test` is a test; workflow files and scripts are left out."""
    last = F.element_at(F.split("name", "/"), -1)
    base = F.replace(F.replace(last, F.lit("test_"), F.lit("")), F.lit("_test"), F.lit(""))
    is_test = F.contains(F.lower("name"), F.lit("test"))
    aside = F.col("name").contains(".github") | F.col("name").contains("scripts/") | F.col("name").contains("script/")
    covered = files.where(is_test).select(base.alias("base")).distinct()
    bare = files.where(~is_test & ~aside).withColumn("base", last).join(covered, "base", "left_anti").orderBy("name").limit(k)
    return bare.where(F.col("symbols") >= least).select(F.col("name").alias("file"), F.col("symbols").alias("n"))


def patch_verdict(baseline: DataFrame, patched: DataFrame, history: DataFrame) -> DataFrame:
    """Paths(path) before and after a patch, and paths cured before → path, verdict."""
    flag = lambda d, c: d.select("path").distinct().withColumn(c, F.lit(True))
    rows = flag(baseline, "b").join(flag(patched, "p"), "path", "full").join(flag(history, "h"), "path", "full")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = F.when(has("b") & has("p"), "SURVIVED").when(has("b"), "CURED").when(has("p") & has("h"), "REGRESSION").when(has("p"), "NEW").otherwise("INACTIVE")
    return rows.select("path", verdict.alias("verdict"))


def disjunctive_links(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """links(symbol_id, symbol_name, ...) with symbols(id, name, file) by id, or by name where the id is null: two equal
    joins instead of one loop over all pairs."""
    s = symbols.select("id", "name", "file")
    by_id = links.where("symbol_id is not null").join(s, F.col("symbol_id") == F.col("id"))
    by_name = links.where("symbol_id is null").join(s, F.col("symbol_name") == F.col("name"))
    return by_id.unionByName(by_name)


def nearest_cached(wanted: DataFrame, cached: DataFrame, most: int = 2000) -> DataFrame:
    """wanted(repo, at), cached(repo, at, commit) → repo, at, commit: the nearest earlier one within `most` commits.

    Both are read in one order and the last cached one carries forward, so nothing is joined by range."""
    none = F.lit(None).cast(cached.schema["commit"].dataType)
    rows = wanted.distinct().select("repo", "at", none.alias("commit"), F.lit(1).alias("asks")).unionByName(cached.select("repo", "at", "commit", F.lit(0).alias("asks")))
    by = Window.partitionBy("repo").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("asks") == 0, F.struct("at", "commit")), True).over(by)
    return rows.withColumn("near", last).where((F.col("asks") == 1) & (F.col("at") - F.col("near.at") <= most)).select("repo", "at", "near.commit")


def mentions(files: DataFrame) -> DataFrame:
    """files(path, code) → path, line, ref, text: the first reference of each line to a decision, a ban or a hotspot, in
    capitals, and the comment that it stands in (the whole line, if it is in none)."""
    lines = files.select("path", F.posexplode(F.split("code", "\r?\n")).alias("n", "row")).where(F.col("row").rlike(MENTION))
    comment = F.regexp_extract("row", r"(?:#|//|\*)\s*(.+)", 1)
    text = F.trim(F.when(comment != "", comment).otherwise(F.col("row")))
    return lines.select("path", (F.col("n") + 1).cast("long").alias("line"), F.replace(F.upper(F.regexp_extract("row", MENTION, 0)), F.lit("  "), F.lit(" ")).alias("ref"), text.alias("text"))


def mention_links(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files(path, code), symbols(path, symbol, kind, start, end) → symbol, source_type, ref, confidence, text: what each
    mention is about, once for each symbol and reference (of several the text of the first line). Outside Python, and in
    files without symbols, it is the file."""
    found = mentions(files)
    near = mention_targets(found.withColumnRenamed("path", "file").select("file", "line"), symbols.where("path LIKE '%.py'").withColumnRenamed("path", "file"))
    rows = found.join(near.withColumnRenamed("file", "path").withColumnRenamed("symbol", "at"), ["path", "line"])
    rows = rows.groupBy(F.col("at").alias("symbol"), "ref").agg(F.min(F.struct("path", "line", "text"))["text"].alias("text"))
    return rows.select("symbol", F.lit("mention").alias("source_type"), "ref", F.lit(0.95).alias("confidence"), "text")


def rebuilt(links: DataFrame, fresh: DataFrame, source_type: str = "mention") -> DataFrame:
    """links without those of a type, and the fresh ones of that type: a rebuild leaves no stale links."""
    return links.where(F.col("source_type") != source_type).unionByName(fresh)


def mention_targets(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """mentions(file, line), symbols(file, symbol, kind, start, end) → file, line, symbol: the next function within two
    lines, else the innermost function around it, else the innermost class, else the next symbol within five lines, else
    the file itself."""
    gap, inside = F.col("start") - F.col("line"), F.col("line").between(F.col("start"), F.col("end"))
    function = F.col("kind").isin("function", "method")
    rank = F.when(function & gap.between(1, 2), 1).when(function & inside, 2).when((F.col("kind") == "class") & inside, 3).when(gap.between(1, 5), 4)
    met = mentions.join(symbols, "file", "left").withColumn("rank", rank)
    size = F.when(F.col("rank").isin(2, 3), F.col("end") - F.col("start")).otherwise(gap)
    by = Window.partitionBy("file", "line").orderBy(F.asc_nulls_last("rank"), size, "symbol")
    return met.withColumn("k", F.row_number().over(by)).where("k = 1").select("file", "line", F.when(F.col("rank").isNotNull(), F.col("symbol")).otherwise(F.col("file")).alias("symbol"))
