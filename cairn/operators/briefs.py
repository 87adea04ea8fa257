"""Smaller operators: predicates, lookups, counters, exports, briefs and scores that the commands are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.contain import contains_join

# Words of entry points, of risky commits, suffixes of files that a task names, and those of code.
SOURCE_WORDS = ("view", "handler", "api", "route", "controller", "request", "middleware")
RISK_WORDS = ("workaround", "temporary", "hack", "bypass", "quick fix", "hotfix", "regression", "disabled", "security")
FILE_SUFFIXES = ("py", "ts", "js", "tsx", "jsx", "java", "go", "rb", "rs", "cpp", "c", "h", "cs", "php", "yaml", "yml", "json", "toml", "md")
CODE_SUFFIXES = ("py", "ts", "js", "java", "go", "rb", "rs", "cpp", "c", "h", "cs", "php")


def has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_resolved(deps: DataFrame) -> DataFrame:
    """deps(name, path) → one row a name: the first path, or null where none is resolved."""
    return deps.groupBy("name").agg(F.min("path").alias("path"))


def containers(classes: DataFrame, methods: DataFrame, most: int = 2) -> DataFrame:
    """classes(name), methods(name) → name, n of classes with few methods."""
    n = methods.groupBy("name").agg(F.count("*").alias("n"))
    return classes.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") <= most)


def reasoning_ratio(bodies: DataFrame, warn: float = 0.3, critical: float = 0.1) -> DataFrame:
    """bodies(body) → ratio of non-empty ones, and its severity."""
    r = bodies.agg(F.round(F.avg(F.when(F.length(F.trim("body")) > 0, 1.0).otherwise(0.0)), 6).alias("ratio"))
    return r.withColumn("severity", F.when(F.col("ratio") < critical, "critical").when(F.col("ratio") < warn, "warning").otherwise("ok"))


def both_sides(edges: DataFrame, items: DataFrame) -> DataFrame:
    """edges(item_a, item_b), items(item) → item, partner: whatever changes with an item, on either side, once."""
    ways = edges.select(F.col("item_a").alias("item"), F.col("item_b").alias("partner")).union(edges.select("item_b", "item_a")).distinct()
    return ways.join(items, "item", "left_semi")


def graph_nodes(symbols: DataFrame, hot: DataFrame) -> DataFrame:
    """symbols(id, group), hot(id) → id, group, hot."""
    return symbols.join(hot.select("id", F.lit(True).alias("hot")).distinct(), "id", "left").select("id", "group", F.coalesce("hot", F.lit(False)).alias("hot"))


def graph_edges(calls: DataFrame, virtual: DataFrame) -> DataFrame:
    """calls(src, dst) without loops and virtual(src, dst) → src, dst, kind."""
    kind = lambda d, k: d.select("src", "dst").distinct().withColumn("kind", F.lit(k))
    return kind(calls.where("src != dst"), "call").unionByName(kind(virtual, "virtual"))


def light_bundle(scored: DataFrame, budget: int, k: int = 10) -> DataFrame:
    """scored(id, score, tokens) → of the k best, those before the budget is reached."""
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    run = F.sum("tokens").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("spent", run).where(F.col("spent") <= budget).select("id", "score", "spent")


def homonyms(symbols: DataFrame, picked: DataFrame) -> DataFrame:
    """symbols(id, name), picked(id) → id, name of others with a picked one's name."""
    names = symbols.join(picked, "id", "left_semi").select("name").distinct()
    return symbols.join(names, "name", "left_semi").join(picked, "id", "left_anti").select("id", "name")


def hotspot_links(hot: DataFrame, symbols: DataFrame, per_item: int = 20) -> DataFrame:
    """hot(item, freq, risk), symbols(item, symbol) → item, symbol of risky items, the first symbols of each."""
    live = hot.where("risk > 0.5 AND freq >= 10").select("item")
    by = Window.partitionBy("item").orderBy("symbol")
    return symbols.distinct().join(live, "item", "left_semi").withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_item).select("item", "symbol")


def edge_findings(edges: DataFrame, least: int = 4, k: int = 8, critical: float = 0.85) -> DataFrame:
    """edges(item_a, item_b, rate, support) → the k strongest, with their severity."""
    rows = edges.where(F.col("support") >= least).withColumn("severity", F.when(F.col("rate") >= critical, "critical").otherwise("warning"))
    return rows.orderBy(F.desc("rate"), "item_a", "item_b").limit(k)


def decay_events(commits: DataFrame, sinks: DataFrame, links: DataFrame) -> DataFrame:
    """commits(ref, body, file), sinks(file), links(ref) → ref, file, summary of risky commits at a file whose path contains
    a sink's, and that no link explains. Refs are compared by their first eight characters, as links keep them."""
    risky = commits.where(has_any(F.lower("body"), RISK_WORDS))
    at_sink = contains_join(risky.select(F.col("file").alias("text")), sinks.select(F.col("file").alias("needle")))
    risky = risky.join(at_sink.select(F.col("text").alias("file")).distinct(), "file", "left_semi")
    own = risky.withColumn("short", F.substring("ref", 1, 8)).join(links.select(F.substring("ref", 1, 8).alias("short")).distinct(), "short", "left_anti")
    return own.select("ref", "file", F.element_at(F.split(F.trim("body"), "\n"), 1).alias("summary"))


def retrospective(signals: DataFrame, blast: DataFrame) -> DataFrame:
    """signals(item, type, signal_class, relevance, at, links) and blast(item, n) → item, score, verdict for each of blast.

    15 for each amnesia signal without links (null: one link) up to 30; 3, 7, 12 or 15 from 5, 15, 30 or 50 dependent files; 7 times the
    relevance (null: 0.5) of semantic warnings, rounded half to even, up to 21; 3 for each awareness warning up to 9; 10 for
    an architectural decision; 10 if two or more dated semantic warnings lie within 36 months of 30.44 days; 8 for an
    intent delta; 97 at most. ALERT from 55, REVIEW from 35."""
    kind = F.col("type")
    warning = lambda c: (kind == "pre_cve_warning") & (F.col("signal_class") == c)
    n = lambda cond: F.count(F.when(cond, 1))
    semantic = warning("semantic")
    dated = F.when(semantic, F.col("at"))
    days = F.floor((F.unix_micros(F.max(dated)) - F.unix_micros(F.min(dated))) / 86_400_000_000)
    points = signals.groupBy("item").agg(
        F.least(F.lit(30), 15 * n((kind == "amnesia") & (F.coalesce("links", F.lit(1)) == 0))).alias("a"),
        F.bround(F.least(F.lit(21.0), 7 * F.sum(F.when(semantic, F.coalesce("relevance", F.lit(0.5))).otherwise(0.0)))).alias("c"),
        F.least(F.lit(9), 3 * n(warning("awareness"))).alias("d"),
        F.when(n(kind == "architectural_decision") > 0, 10).otherwise(0).alias("e"),
        F.when((F.count(dated) >= 2) & (days / 30.44 <= 36), 10).otherwise(0).alias("f"),
        F.when(n(kind == "intent_impl_delta") > 0, 8).otherwise(0).alias("g"),
    )
    b = F.when(F.col("n") >= 50, 15).when(F.col("n") >= 30, 12).when(F.col("n") >= 15, 7).when(F.col("n") >= 5, 3).otherwise(0)
    raw = sum((F.coalesce(F.col(k), F.lit(0)) for k in "acdefg"), b)
    score = F.least(F.lit(97), raw.cast("int"))
    rows = blast.join(points, "item", "left")
    return rows.select("item", score.alias("score"), F.when(score >= 55, "ALERT").when(score >= 35, "REVIEW").otherwise("PASS").alias("verdict"))


def brief(files: DataFrame, hot: DataFrame, integrity: DataFrame) -> DataFrame:
    """files(item), hot(item, freq), integrity(item, score) → item, level, state."""
    level = F.when(F.col("freq") >= 15, "HIGH").when(F.col("freq") >= 5, "MEDIUM").otherwise("LOW")
    state = F.when(F.col("score") >= 0.8, "Healthy").when(F.col("score") >= 0.65, "Neutral").when(F.col("score").isNotNull(), "Drifting").otherwise("Unknown")
    return files.join(hot, "item", "left").join(integrity, "item", "left").select("item", level.alias("level"), state.alias("state"))


def role(imports_tests: Column, name_is_test: Column, base_is_test: Column, path_is_test: Column, file_is_test: Column) -> Column:
    """test if two of five signals agree, else source."""
    n = sum((F.when(c, 1).otherwise(0) for c in (name_is_test, base_is_test, path_is_test, file_is_test)), F.when(imports_tests, 1).otherwise(0))
    return F.when(n >= 2, "test").otherwise("source")


def target_files(text: Column) -> Column:
    """Paths with a known suffix, then dotted modules of three or more names as paths, in order, once each."""
    ends = "|".join(sorted(FILE_SUFFIXES, key=len, reverse=True))
    paths = F.regexp_extract_all(text, F.lit(rf"(?i)[\w./\\-]+\.(?:{ends})"), F.lit(0))
    paths = F.transform(paths, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^[./]+", ""))
    modules = F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){2,}\b"), F.lit(0))
    modules = F.filter(modules, lambda x: ~F.lower(F.element_at(F.split(x, r"\."), -1)).isin(*CODE_SUFFIXES))
    modules = F.transform(modules, lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py")))
    return F.array_distinct(F.concat(F.filter(paths, lambda x: x != ""), modules))


def since(events: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `days` before the newest one."""
    newest = events.agg(F.max(ts).alias("_newest"))
    return events.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")
