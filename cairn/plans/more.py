"""Further operators bound to the test tables, with their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import audit, briefs, mining, quantise, retrieval
from cairn.plans.fixture import SQL_COS, SQL_EDGES, SQL_HOT, SQL_LINKS, _cosine, _links, brand_edges, day, edges, part_hotspots, query, sql_brands, touch
from cairn.functions import text as X
from cairn.session import table


@query("SELECT l_suppkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1")
def item_totals(spark, sf):
    return mining.item_totals(touch(spark, sf, "l_suppkey"))


@query("SELECT p_name AS name, min(CASE WHEN p_size > 25 THEN p_brand END) AS path FROM part GROUP BY 1")
def first_resolved(spark, sf):
    return briefs.first_resolved(table(spark, sf, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("path")))


@query(f"WITH {sql_brands(50, 'e')} SELECT dst AS item, count(DISTINCT src) AS callers FROM e GROUP BY dst HAVING count(DISTINCT src) >= 2")
def graph_callers(spark, sf):
    return brand_edges(spark, sf, 50).groupBy(F.col("dst").alias("item")).agg(F.count("*").alias("callers")).where("callers >= 2")


@query(f"WITH {SQL_HOT} SELECT (SELECT count(*) FROM orders) AS commits, (SELECT count(*) FROM hot WHERE risk > 0.5) AS risky, (SELECT count(*) FROM hot WHERE freq >= 10) AS frequent, (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders) AS since")
def counters(spark, sf):
    hot = part_hotspots(spark, sf).agg(F.count(F.when(F.col("risk") > 0.5, 1)).alias("risky"), F.count(F.when(F.col("freq") >= 10, 1)).alias("frequent"))
    return table(spark, sf, "orders").agg(F.count("*").alias("commits"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("since")).crossJoin(hot)  # one row each


@query("WITH r AS (SELECT round(avg(CASE WHEN length(trim(substr(text, length(split_part(text, chr(10), 1)) + 2))) > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS ratio FROM conversations) SELECT ratio, CASE WHEN ratio < 0.1 THEN 'critical' WHEN ratio < 0.3 THEN 'warning' ELSE 'ok' END AS severity FROM r")
def reasoning_ratio(spark, sf):
    first = F.element_at(F.split("text", "\n"), 1)
    return briefs.reasoning_ratio(table(spark, sf, "conversations").select(F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("body")))


@query("SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(s_suppkey) <= 3")
def containers(spark, sf):
    nation = table(spark, sf, "nation")
    methods = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return briefs.containers(nation.select(F.col("n_name").alias("name")), methods, 3)


@query(f"WITH {SQL_LINKS} SELECT file, count(*) AS n FROM links GROUP BY file")
def link_counts(spark, sf):
    return _links(spark, sf).groupBy("file").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EDGES}, w AS (SELECT item_a AS item, item_b AS partner FROM edges UNION SELECT item_b, item_a FROM edges) SELECT * FROM w WHERE item IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def both_sides(spark, sf):
    return briefs.both_sides(edges(spark, sf), table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("item")))


@query(f"WITH {SQL_HOT} SELECT p_partkey AS id, p_brand AS \"group\", p_partkey IN (SELECT item FROM hot) AS hot FROM part")
def graph_nodes(spark, sf):
    return briefs.graph_nodes(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group")), part_hotspots(spark, sf).select(F.col("item").alias("id")))


@query(f"WITH {sql_brands(50, 'e')}, {sql_brands(49, 'v')} SELECT src, dst, 'call' AS kind FROM e WHERE src <> dst UNION ALL SELECT src, dst, 'virtual' FROM v")
def graph_edges(spark, sf):
    return briefs.graph_edges(brand_edges(spark, sf, 50), brand_edges(spark, sf, 49))


@query(f"WITH {SQL_COS}, t AS (SELECT *, sum(10 + label) OVER (ORDER BY score DESC, id)::BIGINT AS spent FROM (SELECT * FROM cos ORDER BY score DESC, id LIMIT 10)) SELECT id, score, spent FROM t WHERE spent <= 90")
def light_bundle(spark, sf):
    return briefs.light_bundle(_cosine(spark, sf).select("id", "score", (10 + F.col("label")).cast("long").alias("tokens")), 90)


@query(f"""WITH RECURSIVE {SQL_COS}, r AS (SELECT label, id, score, 10 + id % 7 * 9 AS tokens, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS k FROM cos),
f AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS spent, 0 AS taken, false AS kept, NULL::BIGINT AS id, NULL::DOUBLE AS score, NULL::BIGINT AS tokens FROM (SELECT DISTINCT label FROM r)
UNION ALL SELECT r.label, r.k, spent + CASE WHEN taken < 2 OR spent + r.tokens <= 90 THEN r.tokens ELSE 0 END, taken + (taken < 2 OR spent + r.tokens <= 90)::INT, taken < 2 OR spent + r.tokens <= 90, r.id, r.score, r.tokens FROM f JOIN r ON r.label = f.label AND r.k = f.k + 1)
SELECT label AS "group", id, score, tokens FROM f WHERE kept""")
def within_budget(spark, sf):
    """What a greedy reader of each label keeps."""
    return retrieval.within_budget(_cosine(spark, sf).select(F.col("label").alias("group"), "id", "score", (10 + F.col("id") % 7 * 9).cast("long").alias("tokens")), 90)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7) AND p_size <> 7")
def homonyms(spark, sf):
    part = table(spark, sf, "part")
    return briefs.homonyms(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), part.where("p_size = 7").select(F.col("p_partkey").alias("id")))


@query("""WITH c AS (SELECT a.vec_id AS chunk, b.vec_id AS id, round(list_sum(list_transform(generate_series(1, 64), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT chunk, id, round(greatest(0.55, least(0.75, 0.85 * cos)), 5)::DOUBLE AS confidence FROM c WHERE cos >= 0.72""")
def semantic_links(spark, sf):
    e = table(spark, sf, "embeddings")
    chunks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("c"))  # the query set
    return quantise.semantic_links(chunks, e.withColumnRenamed("vec_id", "id"))


@query(f"WITH {SQL_HOT}, s AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS symbol FROM lineitem WHERE l_partkey IN (SELECT item FROM hot WHERE risk > 0.5 AND freq >= 10)) SELECT item, symbol FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY symbol) AS k FROM s) WHERE k <= 20")
def hotspot_links(spark, sf):
    return briefs.hotspot_links(part_hotspots(spark, sf), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("symbol")))


@query(f"WITH {SQL_EDGES} SELECT item_a, item_b, round(rate, 6) AS rate, support, CASE WHEN rate >= 0.85 THEN 'critical' ELSE 'warning' END AS severity FROM edges WHERE support >= 4 ORDER BY edges.rate DESC, item_a, item_b LIMIT 8")
def edge_findings(spark, sf):
    return briefs.edge_findings(edges(spark, sf)).select("item_a", "item_b", F.round("rate", 6).alias("rate"), "support", "severity")


@query("SELECT event_type AS item, round(avg(value) / 100, 6) AS score FROM events GROUP BY 1 HAVING avg(value) / 100 < 0.65 ORDER BY score, item LIMIT 6")
def intent_drift(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("item")).agg(F.round(F.avg("value") / 100, 6).alias("score"))
    return rows.where("score < 0.65").orderBy("score", "item").limit(6)


_RISKY = " OR ".join(f"contains(lower(replace(text, 'license', 'hotfix')), '{w}')" for w in briefs.RISK_WORDS)


@query(f"""SELECT lpad(doc_id::VARCHAR, 8, '0') || 'ff' AS ref, source AS file, split_part(trim(replace(text, 'license', 'hotfix')), chr(10), 1) AS summary FROM documents WHERE ({_RISKY}) AND EXISTS (SELECT 1 FROM nation WHERE contains(source, 'src' || n_nationkey)) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def decay_events(spark, sf):
    body = F.replace(F.col("text"), F.lit("license"), F.lit("hotfix"))
    ref = lambda: F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("ff"))
    commits = table(spark, sf, "documents").select(ref().alias("ref"), body.alias("body"), F.col("source").alias("file"))
    sinks = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("file"))
    return briefs.decay_events(commits, sinks, table(spark, sf, "labels").where("quality = 0").select(ref().alias("ref")))


@query(f"""WITH {SQL_HOT}, s AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_quantity = 50), n AS (SELECT h.item, freq FROM hot h WHERE item IN (FROM s) AND freq >= 10 AND item NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1)),
r AS (SELECT item, freq, least(1.0, 1.5 / (1 + exp(-(freq / 15 - 1.5::DOUBLE)))) AS p FROM n) SELECT item, freq, round(p, 6) AS risk FROM r""")
def sink_amnesia(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "item")
    hot = part_hotspots(spark, sf).where("freq >= 10").join(lines.where("l_quantity = 50").select("item"), "item", "left_semi").join(lines.where("l_discount = 0.1").select("item"), "item", "left_anti")
    return hot.select("item", "freq", X.amnesia_risk(F.col("freq"), F.lit(0))[1].alias("risk"))


@query("""WITH s AS (SELECT o_custkey AS item, left(o_orderpriority, 1)::INT AS p, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 2 END AS links,
CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 / 4 ELSE 0.5 END AS relevance, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS d FROM orders),
f AS (SELECT item, least(30, 15 * count(*) FILTER (p = 1 AND links = 0)) + CASE WHEN count(*) >= 50 THEN 15 WHEN count(*) >= 30 THEN 12 WHEN count(*) >= 15 THEN 7 WHEN count(*) >= 5 THEN 3 ELSE 0 END
+ round_even(least(21, 7 * coalesce(sum(relevance::DOUBLE) FILTER (p = 2), 0)), 0)::INT + least(9, 3 * count(*) FILTER (p = 3)) + CASE WHEN count(*) FILTER (p = 4) > 0 THEN 10 ELSE 0 END
+ CASE WHEN count(d) FILTER (p = 2) >= 2 AND date_diff('day', min(d) FILTER (p = 2), max(d) FILTER (p = 2)) / 30.44 <= 36 THEN 10 ELSE 0 END + CASE WHEN count(*) FILTER (p = 5) > 0 THEN 8 ELSE 0 END AS raw FROM s GROUP BY item),
t AS (SELECT item, least(97, raw)::INT AS score FROM f)
SELECT item, score, CASE WHEN score >= 55 THEN 'ALERT' WHEN score >= 35 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM t""")
def retrospective(spark, sf):
    p, key, o = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey"), table(spark, sf, "orders")
    kind = F.when(p == "1", "amnesia").when(p.isin("2", "3"), "pre_cve_warning").when(p == "4", "architectural_decision").when(p == "5", "intent_impl_delta")
    signals = o.select(
        F.col("o_custkey").alias("item"), kind.alias("type"), F.when(p == "2", "semantic").when(p == "3", "awareness").alias("signal_class"), F.when(key % 4 < 3, key % 4 / 4).alias("relevance"),
        F.when(key % 5 > 0, F.col("o_orderdate").cast("timestamp")).alias("at"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 2).alias("links"),
    )
    return briefs.retrospective(signals, o.groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n")))


@query(f"""WITH {SQL_HOT}, i AS (SELECT l_partkey AS item, round(avg(1 - l_discount), 6) AS score FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT p_partkey AS item, CASE WHEN freq >= 15 THEN 'HIGH' WHEN freq >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN score >= 0.8 THEN 'Healthy' WHEN score >= 0.65 THEN 'Neutral' WHEN score IS NOT NULL THEN 'Drifting' ELSE 'Unknown' END AS state FROM part LEFT JOIN hot ON hot.item = p_partkey LEFT JOIN i ON i.item = p_partkey""")
def brief(spark, sf):
    scores = table(spark, sf, "lineitem").where("l_quantity > 25").groupBy(F.col("l_partkey").alias("item")).agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("score"))
    return briefs.brief(table(spark, sf, "part").select(F.col("p_partkey").alias("item")), part_hotspots(spark, sf).select("item", "freq"), scores)


@query("SELECT CASE WHEN toxic = 1 THEN 'equipped' ELSE 'baseline' END AS arm, round(avg(quality), 6) AS pass_rate FROM labels GROUP BY 1")
def compliance_rate(spark, sf):
    return table(spark, sf, "labels").groupBy(F.when(F.col("toxic") == 1, "equipped").otherwise("baseline").alias("arm")).agg(F.round(F.avg("quality"), 6).alias("pass_rate"))


@query("SELECT p_partkey AS id, CASE WHEN (p_type = 'ECONOMY')::INT + starts_with(p_name, 'small')::INT + (p_size > 25)::INT + ends_with(p_brand, '1')::INT + ends_with(p_name, 'ring')::INT >= 2 THEN 'test' ELSE 'source' END AS role FROM part")
def role(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), briefs.role(c("p_type") == "ECONOMY", c("p_name").startswith("small"), c("p_size") > 25, c("p_brand").endswith("1"), c("p_name").endswith("ring")).alias("role"))


@query(r"""WITH t AS (SELECT page_id, url || ' .\\core\\a.rs and src/B.PY' AS x FROM pages),
f AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(x, '(?i)[\w./\\-]+\.(?:toml|yaml|java|json|tsx|jsx|cpp|php|yml|py|ts|js|go|rb|rs|cs|md|c|h)'), lambda p: regexp_replace(replace(p, '\', '/'), '^[./]+', '')), lambda p: p <> '') AS a,
list_transform(list_filter(regexp_extract_all(x, '\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){2,}\b'), lambda m: lower(split_part(m, '.', -1)) NOT IN ('py', 'ts', 'js', 'java', 'go', 'rb', 'rs', 'cpp', 'c', 'h', 'cs', 'php')), lambda m: replace(m, '.', '/') || '.py') AS b FROM t)
SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS files FROM f""")
def target_files(spark, sf):
    task = F.concat("url", F.lit(" .\\\\core\\\\a.rs and src/B.PY"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(briefs.target_files(task)), ",").alias("files"))


@query("""SELECT page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS base, split_part(url, '/', 4) AS top, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS key,
(contains(lower(url), 'view') OR contains(lower(url), 'handler') OR contains(lower(url), 'api') OR contains(lower(url), 'route') OR contains(lower(url), 'controller') OR contains(lower(url), 'request') OR contains(lower(url), 'middleware')) AS is_source FROM pages""")
def path_parts(spark, sf):
    bare = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.split_part(bare, F.lit("/"), F.lit(-1)).alias("base"), F.split_part("url", F.lit("/"), F.lit(4)).alias("top"), F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_").alias("key"), briefs.has_any(F.lower("url"), briefs.SOURCE_WORDS).alias("is_source"))


@query("SELECT doc_id AS id, floor(length(text) / 3.5)::BIGINT AS tokens, ((len(string_split(text, chr(10))) - 1) * 40 // 4)::BIGINT AS by_lines, substr(text, 1, 80) AS preview FROM documents")
def token_estimates(spark, sf):
    lines = F.size(F.split("text", "\n")) - 1
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.length("text") / 3.5).alias("tokens"), F.floor(lines * 40 / 4).cast("long").alias("by_lines"), F.substring("text", 1, 80).alias("preview"))


@query("SELECT event_id, (regexp_extract('note ' || props || ' end', '\\{[^{}]*\\}')::JSON ->> '$.k')::INT AS k FROM events")
def json_in_text(spark, sf):
    found = F.regexp_extract(F.concat(F.lit("note "), "props", F.lit(" end")), r"\{[^{}]*\}", 0)
    return table(spark, sf, "events").select("event_id", F.from_json(found, "k int")["k"].alias("k"))


@query(f"WITH {SQL_COS} SELECT id, round(1 - score, 4) AS delta, round(1 - (2 - 2 * score) / 2, 4) AS similarity FROM cos WHERE 1 - (2 - 2 * score) / 2 > 0.35")
def intent_delta(spark, sf):
    s = 1 - (2 - 2 * F.col("score")) / 2
    return _cosine(spark, sf).where(s > 0.35).select("id", F.round(1 - F.col("score"), 4).alias("delta"), F.round(s, 4).alias("similarity"))


@query("""WITH w AS (SELECT o_orderpriority AS repo, o_orderkey AS key, o_custkey AS cust, o_totalprice > 480000 AS cached FROM orders),
j AS (SELECT repo, key, max(CASE WHEN cached THEN key END) OVER (PARTITION BY repo ORDER BY key) AS near FROM w)
SELECT j.repo, j.key AS "at", c.cust AS "commit" FROM j JOIN w c ON c.key = j.near WHERE j.key - near <= 2000""")
def nearest_cached(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("commit"), "o_totalprice")
    return audit.nearest_cached(o.select("repo", "at"), o.where("o_totalprice > 480000").select("repo", "at", "commit"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1")
def window_consolidation(spark, sf):
    return briefs.since(table(spark, sf, "events"), 7).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%ring%' ORDER BY p_brand, p_name, p_partkey LIMIT 20")
def name_search(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").contains("ring")).orderBy("p_brand", "p_name", "p_partkey").limit(20).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) >= 100 AND (contains(lower(text), 'with') OR contains(lower(text), 'avec')) AND role = 'user'")
def reasoned_bodies(spark, sf):
    return table(spark, sf, "conversations").where((F.length("text") >= 100) & briefs.has_any(F.lower("text"), ["with", "avec"]) & (F.col("role") == "user")).select("conv_id", "turn")


@query("SELECT s_suppkey AS item, CASE WHEN s_acctbal < 0 THEN 'critical' ELSE 'warning' END AS severity, s_nationkey AS metric, '{\"item\":' || s_suppkey || ',\"nation\":' || s_nationkey || '}' AS report FROM supplier")
def report_rows(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item"), F.when(F.col("s_acctbal") < 0, "critical").otherwise("warning").alias("severity"), F.col("s_nationkey").alias("metric"), F.to_json(F.struct(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("nation"))).alias("report"))


@query(f"""SELECT doc_id AS id, strftime(CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-03' ELSE TIMESTAMP '1970-01-01' END, '%Y-%m-%d') AS at FROM documents""")
def parsed_dates(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, "2024-02-03").otherwise("long ago")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.when_parsed(raw).alias("t")).select("id", day("t").alias("at"))


@query("""WITH w AS (SELECT DISTINCT p_name AS name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AND p_type = 'PROMO')
SELECT p_partkey AS id, round(CASE WHEN p_name IN (FROM w) THEN least(1.0, 1.3 * p_size / 50) ELSE p_size / 50 END, 6)::DOUBLE AS score FROM part""")
def import_chase(spark, sf):
    from cairn.functions import conventions

    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), (F.col("p_size") == 50).alias("is_test"), (F.col("p_size") / 50).alias("score"), "p_type")
    return conventions.import_chase(part.drop("p_type"), part.where("p_type = 'PROMO'").select("file", "name"))
