"""The operators bound to the test tables, each with the SQL that gives the same rows.

The tables hold orders, not commits, so: an order is a commit, its suppliers are files, its parts are symbols, and a
nation is an author. Gates are set so that results aren't empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import audit, graph, mining, retrieval
from cairn.session import parts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


# ---- shared inputs


def touch(spark: SparkSession, sf: str, item: str, partitions: int | None = None) -> DataFrame:
    """basket (order), item and ts, in as many partitions by basket as the number of lines asks for."""
    lines = table(spark, sf, "lineitem")
    n = partitions or parts(lines)
    lines = lines.select(F.col("l_orderkey").alias("basket"), F.col(item).alias("item")).repartition(n, "basket").distinct()
    return lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_orderdate").alias("ts")).repartition(n, "basket"), "basket")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = parts(table(spark, sf, "lineitem"))
    return mining.co_change(touch(spark, sf, "l_suppkey", n), min_support=30, partitions=n)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n = parts(table(spark, sf, "lineitem"))
    t = touch(spark, sf, "l_suppkey", n)
    return mining.virtual_edges(mining.co_change(t, min_support=5, partitions=n), mining.item_totals(t), 5, 0.05)


def part_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))
    return mining.hotspots(mining.item_totals(t))


def rules(spark: SparkSession, sf: str) -> DataFrame:
    n = parts(table(spark, sf, "lineitem"))
    return mining.symbol_co_change(touch(spark, sf, "l_partkey", n), min_conf=0.05, partitions=n)


def brand_edges(spark: SparkSession, sf: str, quantity: int) -> DataFrame:
    """Brand to brand, from one line of an order to the next; two digits, so that text order is number order."""
    name = F.concat(F.lit("B"), F.lpad(F.regexp_extract("p_brand", r"(\d+)$", 1), 2, "0"))
    part = table(spark, sf, "part").select("p_partkey", name.alias("b"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    here = line.where(F.col("l_quantity") == quantity).join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("b").alias("src"))
    there = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("b").alias("dst"))
    return here.join(there, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


SQL_TOUCH = "touch AS (SELECT DISTINCT l_orderkey AS basket, {0} AS item, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SQL_PAIRS = """small AS (SELECT * FROM touch WHERE basket IN (SELECT basket FROM touch GROUP BY basket HAVING count(*) <= {cap})),
pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS support, max(a.ts) AS last_seen FROM small a JOIN small b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL)"""
SQL_EDGES = f"""{SQL_TOUCH.format('l_suppkey')}, {SQL_PAIRS.format(cap=15)},
totals AS (SELECT item, count(DISTINCT basket) AS n FROM touch GROUP BY item),
edges AS (SELECT item_a, item_b, least(1.0, support::DOUBLE / greatest(1, least(a.n, b.n))) AS rate, support FROM pairs JOIN totals a ON a.item = item_a JOIN totals b ON b.item = item_b WHERE support >= 5 AND support::DOUBLE / least(a.n, b.n) > 0.05)"""
SQL_HOT = """freq AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5),
ranked AS (SELECT *, row_number() OVER (ORDER BY freq DESC) AS k, count(*) OVER () AS n FROM freq),
hot AS (SELECT item, freq, least(1.0, freq::DOUBLE / (SELECT max(freq) FROM freq)) AS risk FROM freq WHERE freq >= (SELECT freq FROM ranked WHERE k = greatest(0, floor(n * 0.2)::BIGINT - 1) + 1))"""
SQL_RULES = """ptouch AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ppairs AS (SELECT a.item AS src, b.item AS dst, count(*) AS support, max(a.ts) AS last_seen FROM ptouch a JOIN ptouch b ON a.basket = b.basket AND a.item <> b.item GROUP BY ALL HAVING count(*) >= 3),
ptotals AS (SELECT item, count(*) AS n FROM ptouch GROUP BY item),
rules AS (SELECT src, dst, support, n AS total_src, round(support / n, 4) AS confidence, last_seen FROM ppairs JOIN ptotals ON item = src WHERE support / n >= 0.05)"""


def sql_brands(quantity: int, name: str) -> str:
    b = "'B' || lpad(regexp_extract(p_brand, '(\\d+)$', 1), 2, '0')"
    return f"""{name} AS (SELECT DISTINCT src, dst FROM (SELECT l_orderkey, l_linenumber + 1 AS k, {b} AS src FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = {quantity}) x
JOIN (SELECT l_orderkey, l_linenumber AS k, {b} AS dst FROM lineitem JOIN part ON l_partkey = p_partkey) y USING (l_orderkey, k))"""


# ---- mining


@query(f"WITH {SQL_TOUCH.format('l_suppkey')}, {SQL_PAIRS.format(cap=15)} SELECT item_a, item_b, support, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM pairs WHERE support >= 30")
def co_change(spark, sf):
    return pairs(spark, sf).select("item_a", "item_b", "support", day("last_seen").alias("last_seen"))


@query(f"WITH {SQL_EDGES} SELECT item_a, item_b, round(rate, 6) AS rate, round(2 - rate, 6) AS depth, support FROM edges")
def virtual_edges(spark, sf):
    return edges(spark, sf).select("item_a", "item_b", F.round("rate", 6).alias("rate"), F.round("depth", 6).alias("depth"), "support")


@query(f"WITH {SQL_RULES} SELECT src, dst, support, total_src, confidence, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM rules")
def symbol_co_change(spark, sf):
    return rules(spark, sf).withColumn("last_seen", day("last_seen"))


@query(f"WITH {SQL_HOT} SELECT item, freq, round(risk, 6) AS risk FROM hot")
def hotspots(spark, sf):
    return part_hotspots(spark, sf).withColumn("risk", F.round("risk", 6))


@query("""WITH c AS (SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS callers, any_value(p_size) AS loc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2),
r AS (SELECT *, round(0.6 * callers / (SELECT max(callers) FROM c) + 0.4 * loc / greatest((SELECT max(loc) FROM c), 1), 4) AS risk FROM c)
SELECT item, callers, loc, risk FROM (SELECT *, row_number() OVER (ORDER BY risk DESC, item) AS k, count(*) OVER () AS n FROM r) WHERE k <= greatest(1, floor(0.3 * n))""")
def cold_hotspots(spark, sf):
    callers = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("callers"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("loc"))
    return mining.cold_hotspots(callers.withColumnRenamed("l_partkey", "item").join(part, "item").select("item", "callers", "loc"))


@query(r"""WITH h AS (SELECT l_suppkey AS file, l_orderkey AS s, l_orderkey + l_linenumber AS e, CASE l_returnflag WHEN 'R' THEN 'Fixes rounding' WHEN 'A' THEN 'prefix handling' ELSE 'feature' END AS body FROM lineitem),
y AS (SELECT DISTINCT l_suppkey AS file, l_orderkey // 700 AS symbol, l_orderkey // 700 * 700 AS s, l_orderkey // 700 * 700 + 699 AS e FROM lineitem),
c AS (SELECT y.file, symbol, count(*) AS score FROM h JOIN y ON h.file = y.file AND NOT (h.e < y.s OR h.s > y.e) WHERE regexp_matches(lower(body), '\b(fix(es|ed|ing)?|bug(fix)?|regression)\b') GROUP BY ALL HAVING count(*) >= 2)
SELECT file, symbol, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, symbol) AS k FROM c) WHERE k <= 5""")
def fragility(spark, sf):
    lines = table(spark, sf, "lineitem")
    body = F.when(F.col("l_returnflag") == "R", "Fixes rounding").when(F.col("l_returnflag") == "A", "prefix handling").otherwise("feature")
    hunks = lines.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"), body.alias("body"))
    symbols = lines.select(F.col("l_suppkey").alias("file"), F.floor(F.col("l_orderkey") / 700).alias("symbol")).distinct()
    return mining.fragility(mining.fix_hunks(hunks), symbols.select("file", "symbol", (F.col("symbol") * 700).alias("start"), (F.col("symbol") * 700 + 699).alias("end")))


def _nations(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("author"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(orders, "l_orderkey").select("item", "author")


SQL_NATIONS = "t AS (SELECT l_partkey AS item, c_nationkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {SQL_NATIONS}, c AS (SELECT item, author, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY item)::BIGINT AS total FROM c)
SELECT item, author, round(n / total, 6) AS share, total FROM s WHERE n / total >= 0.2 AND total >= 3""")
def bus_factor(spark, sf):
    return mining.bus_factor(_nations(spark, sf), min_share=0.20).withColumn("share", F.round("share", 6))


@query(f"WITH {SQL_NATIONS} SELECT author, count(*) AS n FROM t GROUP BY author ORDER BY n DESC, author LIMIT 10")
def author_summary(spark, sf):
    return mining.author_summary(_nations(spark, sf))


SQL_SPOF = "spof AS (SELECT l_partkey AS item, count(DISTINCT o_custkey) AS n_distinct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 5 ORDER BY n_distinct DESC, item LIMIT 15)"


@query(f"WITH {SQL_SPOF} SELECT * FROM spof")
def spof(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("other"))
    return mining.fan(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(orders, "l_orderkey"), 5)


@query("SELECT l_suppkey AS item, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20 ORDER BY n_distinct DESC, item LIMIT 15")
def high_coupling(spark, sf):
    return mining.fan(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("other")), 20)


@query("""WITH e AS (SELECT DISTINCT p_brand AS item, l_suppkey AS other FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_returnflag = 'R'),
d AS (SELECT item, count(*) AS n FROM e GROUP BY item HAVING count(*) >= 2),
p AS (SELECT a.item AS a, b.item AS b, count(*) AS shared FROM e a JOIN e b ON a.other = b.other AND a.item < b.item GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT a, b, shared / (x.n + y.n - shared) AS jaccard FROM p JOIN d x ON x.item = a JOIN d y ON y.item = b)
SELECT a, b, round(jaccard, 6) AS jaccard, round(least(0.65, jaccard), 4) AS rate, round(2 - round(least(0.65, jaccard), 4), 6) AS depth FROM j WHERE jaccard >= 0.1""")
def jaccard_coupling(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'")
    e = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("item"), F.col("l_suppkey").alias("other"))
    return mining.jaccard_coupling(e, gate=0.10).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "rate", F.round("depth", 6).alias("depth"))


@query(f"""WITH {SQL_TOUCH.format('l_suppkey')}, {SQL_PAIRS.format(cap=15)}, f AS (SELECT * FROM (SELECT *, (item_a % 10) / 10 AS fragility, row_number() OVER (PARTITION BY item_a ORDER BY support DESC, item_b) AS rank FROM pairs WHERE support >= 30))
SELECT item_a, item_b, support, rank FROM f WHERE rank <= CASE WHEN fragility < 0.3 THEN 1 WHEN fragility < 0.7 THEN 3 ELSE 6 END""")
def co_change_sparsify(spark, sf):
    fragile = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_a"), (F.col("s_suppkey") % 10 / 10).alias("fragility"))
    return mining.sparsify(pairs(spark, sf), fragile).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH RECURSIVE nxt AS (SELECT e.user_id, e.ts, (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.ts < e.ts - INTERVAL 6 HOUR) AS after FROM events e),
g AS (SELECT user_id, max(ts) AS anchor, 1::BIGINT AS grp FROM events GROUP BY user_id UNION ALL SELECT g.user_id, nxt.after, g.grp + 1 FROM g JOIN nxt ON nxt.user_id = g.user_id AND nxt.ts = g.anchor WHERE nxt.after IS NOT NULL)
SELECT g.user_id AS author, grp AS "group", strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n
FROM g JOIN events e ON e.user_id = g.user_id AND e.ts <= g.anchor AND e.ts >= g.anchor - INTERVAL 6 HOUR GROUP BY g.user_id, grp""")
def macro_change(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("user_id").alias("author"), "ts")
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return mining.macro_change(e, hours=6).select("author", "group", when("first_ts"), when("last_ts"), "n")


@query("""WITH d AS (SELECT event_type AS item, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS score FROM events GROUP BY ALL),
l AS (SELECT item, day, lag(score) OVER (PARTITION BY item ORDER BY day) AS before, score AS after FROM d)
SELECT item, day, before, after, round((before - after) / before, 6) AS drop_pct, (before - after) / before > 0.2 AS alert FROM l WHERE before IS NOT NULL""")
def integrity_trend(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("item"), day("ts").alias("at")).agg(F.round(F.avg("value"), 6).alias("score"))
    return mining.integrity_trend(d).withColumn("drop_pct", F.round("drop_pct", 6)).withColumnRenamed("at", "day")


@query("""SELECT user_id AS key, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days, count(DISTINCT ts::DATE) >= 2 AND date_diff('day', min(ts)::DATE, max(ts)::DATE) / 30.44 <= 36 AS flag
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def temporal_cluster(spark, sf):
    return mining.temporal_cluster(table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("at")))


# ---- audits

SQL_AMNESIA = "amnesia AS (SELECT item, freq, risk FROM hot WHERE freq >= 15 AND item NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40))"


def _amnesia(spark, sf):
    links = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("item"))
    return audit.amnesia(part_hotspots(spark, sf), links)


@query(f"WITH {SQL_HOT}, {SQL_AMNESIA} SELECT item, freq, round(risk, 6) AS risk FROM amnesia")
def amnesia(spark, sf):
    return _amnesia(spark, sf).withColumn("risk", F.round("risk", 6))


@query("""WITH f AS (SELECT CASE WHEN n_chars > 3000 THEN 'long' ELSE 'short' END AS finding_type, doc_id AS key, n_chars FROM documents WHERE n_chars > 3000 OR n_chars < 500)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = key AND ((toxic = 1 AND finding_type = 'long') OR quality = 0))""")
def suppressed_findings(spark, sf):
    kind = F.when(F.col("n_chars") > 3000, "long").otherwise("short")
    f = table(spark, sf, "documents").where("n_chars > 3000 OR n_chars < 500").select(kind.alias("finding_type"), F.col("doc_id").alias("key"), "n_chars")
    marks = table(spark, sf, "labels")
    fb = marks.where("toxic = 1").select(F.lit("long").alias("finding_type"), F.col("doc_id").alias("key")).unionByName(marks.where("quality = 0").select(F.lit("all").alias("finding_type"), F.col("doc_id").alias("key")))
    return audit.suppress(f, fb)


@query(f"""WITH {SQL_EDGES}, {SQL_HOT}, {SQL_RULES}, both_ways AS (SELECT item_a AS src, item_b AS dst, rate FROM edges UNION SELECT item_b, item_a, rate FROM edges), changed AS (SELECT p_partkey AS item FROM part WHERE p_size = 7)
SELECT 'hotspot' AS kind, item AS src, NULL::BIGINT AS dst, round(risk, 6) AS score FROM hot WHERE item IN (FROM changed)
UNION ALL SELECT 'edge', src, dst, round(rate, 6) FROM both_ways WHERE src IN (FROM changed) AND dst NOT IN (FROM changed)
UNION ALL SELECT 'rule', src, dst, round(confidence, 6) FROM rules WHERE src IN (FROM changed) AND dst NOT IN (FROM changed)""")
def pr_check(spark, sf):
    changed = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("item"))
    return audit.pr_check(changed, part_hotspots(spark, sf), edges(spark, sf), rules(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SQL_HOT}, {SQL_AMNESIA}, {SQL_SPOF}, f AS (SELECT 'hotspot' AS category, item FROM hot UNION ALL SELECT 'amnesia', item FROM amnesia UNION ALL SELECT 'spof', item FROM spof)
SELECT item, count(DISTINCT category) AS n_categories, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM f GROUP BY item HAVING count(DISTINCT category) >= 2""")
def compound_risk(spark, sf):
    named = lambda n, d: d.select(F.lit(n).alias("category"), "item")
    return audit.compound_risk(named("hotspot", part_hotspots(spark, sf)).unionByName(named("amnesia", _amnesia(spark, sf))).unionByName(named("spof", spof(spark, sf))))


@query(f"""WITH {SQL_EDGES}, {SQL_HOT}, top AS (SELECT * FROM hot ORDER BY risk DESC, item LIMIT 10),
s AS (SELECT round(greatest(10.0, least(100.0, 100 - 25 * coalesce(round(avg(risk), 2), 0) - least(15, 3 * (SELECT count(*) FROM edges WHERE rate >= 0.7 AND item_a IN (SELECT item FROM top) AND item_b IN (SELECT item FROM top))) + CASE WHEN (SELECT count(*) FROM labels) > 0 THEN 10 ELSE 0 END)), 1) AS score FROM top)
SELECT score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM s""")
def health_score(spark, sf):
    return audit.health_score(part_hotspots(spark, sf), edges(spark, sf), table(spark, sf, "labels").agg(F.count("*").alias("n")))


def _counts(spark, sf):
    links = table(spark, sf, "benchmark").agg(F.count("*").alias("links"))
    hot = part_hotspots(spark, sf).where("risk >= 0.7").agg(F.count("*").alias("hot"))
    n_edges = edges(spark, sf).agg(F.count("*").alias("edges"))
    return links.crossJoin(hot).crossJoin(n_edges)  # one row each


SQL_COUNTS = f"WITH {SQL_EDGES}, {SQL_HOT}, c AS (SELECT (SELECT count(*) FROM benchmark) AS links, (SELECT count(*) FROM hot WHERE risk >= 0.7) AS hot, (SELECT count(*) FROM edges) AS edges)"


@query(f"""{SQL_COUNTS}, s AS (SELECT 15.0::DOUBLE + least(20.0, 5.0 * links)::DOUBLE AS a, 35.0::DOUBLE - least(20.0, 4.0 * hot)::DOUBLE AS b, 15.0::DOUBLE + CASE WHEN edges > 0 THEN 15 ELSE 0 END AS c FROM c)
SELECT a AS governance, b AS resilience, c AS third_party, round(a + b + c, 1) AS score, CASE WHEN a + b + c >= 85 THEN 'A' WHEN a + b + c >= 65 THEN 'B' ELSE 'C' END AS tier,
CASE WHEN a >= 25 THEN 'COMPLIANT' ELSE 'PARTIAL' END AS governance_status, CASE WHEN b >= 25 THEN 'COMPLIANT' ELSE 'PARTIAL' END AS resilience_status, CASE WHEN c >= 25 THEN 'COMPLIANT' ELSE 'PARTIAL' END AS third_party_status FROM s""")
def dora_score(spark, sf):
    return audit.dora_score(_counts(spark, sf))


@query(f"""{SQL_COUNTS}, s AS (SELECT 15.0::DOUBLE + CASE WHEN links > 0 THEN least(10.0, 2.0 * links) ELSE 0 END::DOUBLE - least(10.0, 3.0 * hot)::DOUBLE AS a, 10.0::DOUBLE + CASE WHEN links > 0 THEN 10 ELSE 0 END + 5 AS d,
5.0::DOUBLE + CASE WHEN (SELECT count(*) FROM conversations WHERE role = 'user') > 0 THEN 10 ELSE 0 END AS h FROM c)
SELECT a AS article_9, 15.0::DOUBLE AS article_10, d AS article_11, 10.0::DOUBLE AS article_12, h AS article_14, round(a + d + h + 25, 1) AS score, CASE WHEN a + d + h + 25 >= 85 THEN 'A' WHEN a + d + h + 25 >= 65 THEN 'B' ELSE 'C' END AS tier FROM s""")
def ai_act_score(spark, sf):
    talk = table(spark, sf, "conversations").agg(F.count(F.when(F.col("role") == "assistant", 1)).alias("prompts"), F.count(F.when(F.col("role") == "user", 1)).alias("hitl"))
    return audit.ai_act_score(_counts(spark, sf).crossJoin(talk).withColumn("has_ai", F.lit(True)))


SQL_LINKS = """syms AS (SELECT 'src' || (item_id % 20) AS file, 'item' || item_id AS symbol FROM benchmark),
hits AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS ref, text AS body, source AS file, (contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT) AS k FROM documents),
links AS (SELECT coalesce(symbol, hits.file) AS symbol, hits.file, ref, round(least(1.0, 0.6 + 0.1 * k), 6)::DOUBLE AS confidence, substr(split_part(body, chr(10), 1), 1, 120) AS description
FROM hits LEFT JOIN syms ON syms.file = hits.file WHERE k > 0 ORDER BY ref, hits.file, symbol LIMIT 5000)"""


def _links(spark, sf):
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("ref"), F.col("text").alias("body"), F.array("source").alias("files"))
    syms = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("file"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("symbol"))
    return audit.commit_links(d, syms, ["license", "token"])


@query(f"WITH {SQL_LINKS} SELECT * FROM links")
def commit_links(spark, sf):
    return _links(spark, sf)


@query(f"""WITH {SQL_LINKS} SELECT symbol, file, ref, confidence, description FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, ref, symbol) AS k FROM links WHERE file IN (SELECT 'src' || n_nationkey FROM nation)) WHERE k <= 10""")
def scoped_context(spark, sf):
    keys = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("file"))
    return audit.scoped_context(_links(spark, sf), keys)


@query("""WITH f AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'test_' WHEN p_size < 10 THEN 'scripts/' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_size || '.py' AS name, sum(p_partkey % 10)::BIGINT AS symbols FROM part GROUP BY 1),
b AS (SELECT replace(replace(split_part(name, '/', -1), 'test_', ''), '_test', '') AS base FROM f WHERE contains(lower(name), 'test')),
k AS (SELECT name, symbols FROM f WHERE NOT contains(lower(name), 'test') AND NOT contains(name, 'scripts/') AND split_part(name, '/', -1) NOT IN (FROM b) ORDER BY name LIMIT 5)
SELECT name AS file, symbols AS n FROM k WHERE symbols >= 5""")
def test_gap(spark, sf):
    stem = F.concat(F.when(F.col("p_type") == "ECONOMY", "test_").when(F.col("p_size") < 10, "scripts/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))
    files = table(spark, sf, "part").groupBy(stem.alias("name")).agg(F.sum(F.col("p_partkey") % 10).alias("symbols"))
    return audit.test_gap(files)


@query(f"""WITH {sql_brands(50, 'b')}, {sql_brands(49, 'p')}, {sql_brands(48, 'h')}, u AS (SELECT src || ',' || dst AS path, 1 AS b, 0 AS p, 0 AS h FROM b UNION ALL SELECT src || ',' || dst, 0, 1, 0 FROM p UNION ALL SELECT src || ',' || dst, 0, 0, 1 FROM h),
a AS (SELECT path, max(b) AS b, max(p) AS p, max(h) AS h FROM u GROUP BY path)
SELECT path, CASE WHEN b + p = 2 THEN 'SURVIVED' WHEN b = 1 THEN 'CURED' WHEN p + h = 2 THEN 'REGRESSION' WHEN p = 1 THEN 'NEW' ELSE 'INACTIVE' END AS verdict FROM a""")
def patch_verdict(spark, sf):
    sets = [brand_edges(spark, sf, q).select(F.concat_ws(",", "src", "dst").alias("path")) for q in (50, 49, 48)]
    return audit.patch_verdict(*sets)


# ---- retrieval

SQL_COS = "cos AS (SELECT e.vec_id AS id, e.label, round(list_sum(list_transform(generate_series(1, 64), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _query_vector(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]


def _cosine(spark, sf):
    return retrieval.cosine(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(spark, sf))


@query(f"WITH {SQL_COS} SELECT id, score FROM cos ORDER BY score DESC, id LIMIT 5")
def cosine_topk(spark, sf):
    return retrieval.cosine_topk(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(spark, sf))


SQL_BM25 = """q AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS t FROM benchmark WHERE item_id = 0) WHERE t <> ''),
w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
tf AS (SELECT doc_id, source, len(w) AS l, t, count(*) AS tf FROM (SELECT doc_id, source, w, unnest(w) AS t FROM w) WHERE t IN (FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT doc_id, any_value(source) AS source, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))), 6) AS score FROM tf JOIN df USING (t), st GROUP BY doc_id)"""


def _bench_text(spark, sf) -> str:
    return table(spark, sf, "benchmark").where("item_id = 0").first()["text"]


@query(f"WITH {SQL_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), _bench_text(spark, sf))


@query(f"""WITH {SQL_COS}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM cos QUALIFY r <= 50), b AS (SELECT id, row_number() OVER (ORDER BY label DESC, id) AS r FROM cos QUALIFY r <= 50)
SELECT id, round(sum(s), 8) AS score FROM (SELECT id, 0.6::DOUBLE / (60 + r) AS s FROM a UNION ALL SELECT id, 0.4::DOUBLE / (60 + r) FROM b) GROUP BY id""")
def rrf_fusion(spark, sf):
    c = _cosine(spark, sf).select("id", "label", "score")
    return retrieval.rrf_fusion(retrieval.ranked(c, 50, F.desc("score"), F.col("id")), retrieval.ranked(c, 50, F.desc("label"), F.col("id")))


@query(f"WITH {SQL_COS} SELECT id, round(score * CASE WHEN label % 2 = 0 THEN 0.5 ELSE 1 END * CASE WHEN label % 5 = 0 THEN 0.5 ELSE 1 END, 8)::DOUBLE AS score FROM cos")
def semantic_penalty(spark, sf):
    return retrieval.semantic_penalty(_cosine(spark, sf).select("id", "score", (F.col("label") % 2 == 0).alias("is_test"), (F.col("label") % 5 == 0).alias("is_container")))


@query(f"""WITH {SQL_BM25} SELECT id, round(s, 6) AS score FROM (SELECT d.doc_id AS id, coalesce(b.score, 0)::DOUBLE + CASE WHEN d.source IN ('src0', 'src1') THEN 0.5 ELSE 0 END AS s FROM documents d LEFT JOIN (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) b USING (doc_id)) WHERE s > 0 ORDER BY score DESC, id LIMIT 30""")
def structural_seed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"))
    scored = docs.join(bm25(spark, sf), "doc_id", "left").withColumnRenamed("doc_id", "id")
    return retrieval.structural_seed(scored, ["src0", "src1"])


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def grounding(spark, sf):
    return retrieval.grounding(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


SQL_STOP = "(" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + ")"


@query(f"""WITH q AS (SELECT list(DISTINCT t) AS q FROM (SELECT unnest(regexp_split_to_array(lower(text), '[\\s_]+')) AS t FROM benchmark WHERE item_id = 0) WHERE t <> '' AND t NOT IN {SQL_STOP}),
s AS (SELECT item_id AS id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[\\s_]+')), q)) / greatest(1, len(q)), 6) AS score FROM benchmark, q) SELECT id, score FROM s WHERE score > 0.15""")
def word_overlap(spark, sf):
    return retrieval.word_overlap(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), _bench_text(spark, sf))


@query("""WITH q AS (SELECT label, min(vec_id) AS q FROM embeddings GROUP BY label), v AS (SELECT q.label, e.embedding AS qe, q.q FROM q JOIN embeddings e ON e.vec_id = q.q),
s AS (SELECT v.label, e.label AS other, e.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: e.embedding[i]::DOUBLE * v.qe[i]::DOUBLE)), 6) AS score FROM v JOIN embeddings e ON e.vec_id <> v.q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s), b AS (SELECT label, min(k) FILTER (other = label) AS rank FROM r GROUP BY label)
SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall FROM b, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k""")
def recall_at_k(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings")
    first = e.groupBy(F.col("label").alias("item")).agg(F.min("vec_id").alias("q"))
    asked = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe")).join(first, "q").select("item", "q", "qe")  # one row a label
    scored = e.join(F.broadcast(asked), F.col("vec_id") != F.col("q")).select("item", "vec_id", "label", F.round(retrieval.dot(F.col("embedding"), F.col("qe")), 6).alias("score"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("k", F.row_number().over(by)).groupBy("item").agg(F.min(F.when(F.col("label") == F.col("item"), F.col("k"))).alias("rank"))
    return retrieval.recall_at_k(best)


@query("""SELECT p_brand AS file, string_agg(p_name, ', ' ORDER BY p_name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE k <= 10 GROUP BY p_brand""")
def project_map(spark, sf):
    return retrieval.project_map(table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name")))


# ---- graph


def _nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"""WITH RECURSIVE {sql_brands(50, 'e')}, p AS (SELECT src AS source, src AS node, 1 AS length, src AS path FROM (SELECT unnest(['B01', 'B02', 'B03', 'B20']) AS src)
UNION ALL SELECT source, dst, length + 1, min(path || '>' || dst) FROM p JOIN e ON e.src = node WHERE length < 40 GROUP BY source, dst, length)
SELECT source, node AS sink, length, path FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY length, path) AS k FROM p WHERE node IN ('B20', 'B21', 'B22', 'B23', 'B24')) WHERE k = 1 ORDER BY source, length, path LIMIT 15""")
def taint_paths(spark, sf):
    return graph.taint_paths(brand_edges(spark, sf, 50), _nodes(spark, ["B01", "B02", "B03", "B20"]), _nodes(spark, ["B20", "B21", "B22", "B23", "B24"]))


@query(f"""WITH {sql_brands(50, 'e')} SELECT dst AS symbol, count(DISTINCT src) AS n_callers, count(DISTINCT src) FILTER (src < 'B10') AS n_exposed FROM e WHERE dst IN ('B05', 'B11', 'B17') GROUP BY dst""")
def blast_radius(spark, sf):
    calls = brand_edges(spark, sf, 50).select(F.col("dst").alias("symbol"), F.col("src").alias("caller"))
    return graph.blast_radius(calls, spark.createDataFrame([("B05",), ("B11",), ("B17",)], "symbol string"), calls.where("caller < 'B10'").select("caller"))


@query(f"WITH {sql_brands(50, 'e')} SELECT DISTINCT src AS root, dst AS node FROM e WHERE src IN ('B01', 'B02') AND src <> dst ORDER BY root, node LIMIT 30")
def downstream(spark, sf):
    return graph.downstream(brand_edges(spark, sf, 50), _nodes(spark, ["B01", "B02"]))


@query(f"""WITH RECURSIVE {sql_brands(50, 'e')}, k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) WHERE k <= 5),
p AS (SELECT root, root AS node, 0 AS depth FROM (SELECT unnest(['B07', 'B19']) AS root) UNION ALL SELECT root, dst, depth + 1 FROM p JOIN k ON src = node WHERE depth < 3)
SELECT root, node, min(depth)::INT AS depth FROM p GROUP BY ALL""")
def traverse(spark, sf):
    return graph.traverse(brand_edges(spark, sf, 50), _nodes(spark, ["B07", "B19"]))


# ---- functions

DIFF = (
    ("a.py", 1, "-", "if val > 0:"), ("a.py", 2, "+", "if val >= 0:"), ("a.py", 3, "-", "    assert isinstance(x, int)"), ("a.py", 4, "-", "n == limit and m != top"), ("a.py", 5, "+", "n != limit and m != top"),
    ("b.go", 1, "-", "if err != nil {"), ("b.go", 2, "-", "total < cap"), ("b.go", 3, "+", "total < cap"), ("b.go", 4, "+", "other <= cap"), ("b.go", 5, "-", "if (!ok) return"), ("b.go", 6, "-", "x is None"), ("b.go", 7, "-", "raise TypeError"),
)
SQL_DIFF = "diff(file, line, sign, text) AS (VALUES " + ", ".join("('{}', {}, '{}', '{}')".format(*r) for r in DIFF) + ")"


def _diff(spark):
    return spark.createDataFrame(DIFF, "file string, line int, sign string, text string")


_PART = "regexp_extract(c, '{0}', {1})"


@query(f"""WITH {SQL_DIFF}, m AS (SELECT file, sign, unnest(regexp_extract_all(text, '{X.COMPARISON}')) AS c FROM diff),
p AS (SELECT file, sign, {_PART.format(X.COMPARISON, 1)} AS l, {_PART.format(X.COMPARISON, 2)} AS o, {_PART.format(X.COMPARISON, 3)} AS r FROM m)
SELECT a.file, a.o AS old_op, b.o AS new_op, a.l AS "left", a.r AS "right" FROM p a JOIN p b ON a.file = b.file AND a.sign = '-' AND b.sign = '+' AND (a.l = b.l OR a.r = b.r) AND a.o <> b.o""")
def boundary_mutation(spark, sf):
    return X.boundary_mutations(_diff(spark))


SQL_GUARDS = " OR ".join(f"contains(text, '{g}')" for g in X.GUARDS)


@query(f"WITH {SQL_DIFF} SELECT file, trim(text) AS guard FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM diff WHERE sign = '-' AND ({SQL_GUARDS})) WHERE k <= 3")
def guard_removal(spark, sf):
    return X.guard_removals(_diff(spark))


_AS_CODE = "replace(replace({0}, '. ', chr(10)), ', ', '  # ')"


@query(f"""WITH l AS (SELECT doc_id AS id, string_split({_AS_CODE.format('text')}, chr(10)) AS l FROM documents),
k AS (SELECT id, list_filter(l, lambda x: NOT starts_with(trim(x, ' ' || chr(9)), '#') OR contains(x, 'ADR-') OR contains(x, '[L4:') OR contains(x, '[L5:') OR contains(x, 'noqa') OR contains(x, 'type: ignore')) AS l FROM l),
c AS (SELECT id, list_transform(l, lambda x: CASE WHEN trim(x, ' ' || chr(9)) = '' THEN '' WHEN instr(x, '  #') > 0 AND NOT starts_with(trim(x, ' ' || chr(9)), '#') AND NOT (contains(substr(x, instr(x, '  #') + 3), 'ADR-') OR contains(substr(x, instr(x, '  #') + 3), '[L4:') OR contains(substr(x, instr(x, '  #') + 3), '[L5:') OR contains(substr(x, instr(x, '  #') + 3), 'noqa')) THEN rtrim(substr(x, 1, instr(x, '  #') - 1), ' ' || chr(9)) ELSE x END) AS l FROM k)
SELECT id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM c""")
def comment_prune(spark, sf):
    code = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("  # "))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.prune_comments(code).alias("text"))


def _sql_leaks() -> str:
    text, n = "replace(replace(text, 'license', 'security patch exploits'), 'token', 'CVE-2024-12345')", "0"
    for p in X.LEAKS:
        n += f" + len(regexp_extract_all({text}, '{p}'))"
        text = f"regexp_replace({text}, '{p}', '[SANITIZED]', 'g')"
    return f"SELECT doc_id AS id, {text} AS text, ({n})::INT AS n FROM documents"


@query(_sql_leaks())
def leak_sanitize(spark, sf):
    raw = F.replace(F.replace(F.col("text"), F.lit("license"), F.lit("security patch exploits")), F.lit("token"), F.lit("CVE-2024-12345"))
    text, n = X.sanitize_leaks(raw)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text"), n.alias("n"))


def _sql_any(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"


@query(f"""WITH m AS (SELECT conv_id, turn, lower(split_part(text, chr(10), 1)) AS s, lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS b FROM conversations),
f AS (SELECT *, length(trim(b)) > 20 AS has_body, ({' OR '.join(f"starts_with(s, '{w}')" for w in X.SEMANTIC)}) AS semantic FROM m)
SELECT conv_id, turn, CASE WHEN {_sql_any('s', X.NOISE)} AND NOT has_body THEN 'LOW' WHEN {_sql_any("s || b", X.SECURITY)} AND NOT has_body THEN 'SUSPICIOUS' WHEN semantic AND has_body THEN 'HIGH' ELSE 'MEDIUM' END AS quality FROM f""")
def message_quality(spark, sf):
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf, "conversations").select("conv_id", "turn", X.message_quality(first, F.substring(F.col("text"), F.length(first) + 2, F.length("text"))).alias("quality"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'adr') THEN 'adr' WHEN contains(lower(url), 'spec') THEN 'spec' WHEN contains(lower(url), 'design') OR contains(lower(url), 'arch') THEN 'design' WHEN contains(lower(url), 'rfc') OR contains(lower(url), 'proposal') THEN 'proposal' ELSE 'decision' END AS class FROM pages""")
def doc_class(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.doc_class(F.col("url")).alias("class"))


@query("""WITH p AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN l_quantity = 50 THEN l_suppkey END) AS links FROM lineitem GROUP BY 1),
a AS (SELECT *, 1 / (1 + exp(-(n / 15 - 1.5::DOUBLE))) AS prior FROM p), b AS (SELECT *, CASE WHEN links > 0 THEN prior * pow(0.2::DOUBLE, links) ELSE least(1.0, 1.5 * prior) END AS post FROM a),
c AS (SELECT *, 1.96 * sqrt(greatest(0.0, post * (1 - post) / greatest(1, n))) AS half FROM b)
SELECT item, n, links, round(prior, 6) AS prior, round(post, 6) AS posterior, round(greatest(0.0, post - half), 6) AS ci_low, round(least(1.0, post + half), 6) AS ci_high FROM c""")
def amnesia_risk(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count_distinct("l_orderkey").alias("n"), F.count_distinct(F.when(F.col("l_quantity") == 50, F.col("l_suppkey"))).alias("links"))
    names = ("prior", "posterior", "ci_low", "ci_high")
    return rows.select("item", "n", "links", *[c.alias(n) for c, n in zip(X.amnesia_risk(F.col("n"), F.col("links")), names, strict=True)])


@query("""SELECT o_orderkey AS id, round(greatest(0.05, least(1.0, (CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.7 ELSE 0.5 END::DOUBLE + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.1 ELSE 0 END) * greatest(0.5, 1 - 0.05 * (o_custkey % 14))::DOUBLE - 0.2 * (o_orderkey % 3))), 6)::DOUBLE AS risk FROM orders""")
def path_risk(spark, sf):
    base = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.5)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.path_risk(base, F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") % 14 + 1, F.col("o_orderkey") % 3).alias("risk"))


@query("SELECT p_partkey AS id, sha256(p_brand || ',' || p_name || ',' || p_type) AS fingerprint FROM part")
def fingerprint(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.fingerprint(F.array("p_brand", "p_name", "p_type")).alias("fingerprint"))


@query("SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_ingest(spark, sf):
    """The latest event of each key, upserted from a stream of the table's files."""
    import uuid

    from cairn.session import folder
    from cairn.streaming import ingest

    schema = table(spark, sf, "events").schema
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest.stream_ingest(spark, f"{sf}/events.parquet*", schema, f"{at}/table", f"{at}/progress", ["event_type", "user_id"], ["ts", "event_id"], form="parquet", buckets=8).awaitTermination()
    return ingest.read_latest(spark, f"{at}/table", schema).select("event_type", "user_id", "event_id", "value")
