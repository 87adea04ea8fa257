"""The change check bound to the test tables: an order is a change of its suppliers' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import change
from cairn.plans.fixture import query
from cairn.session import table
from cairn.streaming import ingest

_PATH = "CASE k % 4 WHEN 0 THEN 'src/f' || k || '.py' WHEN 1 THEN 'docs/f' || k || '.md' WHEN 2 THEN 'tests/test_f' || k || '.py' ELSE 'src/f' || k || '.go' END"


def _inputs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    path = lambda d: _PATH.replace(" k ", f" (k + {d}) ").replace("|| k ||", f"|| (k + {d}) ||") if d else _PATH
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS change", "l_suppkey AS k", "l_quantity AS q")
    mine = s.withColumn("file", F.expr(_PATH))
    both = lines.selectExpr("change", f"{_PATH} AS file", "q")
    return {
        "changed": both.select("change", "file"),
        "hotspots": mine.selectExpr("file", "k % 40 AS freq", "(k % 10) / 10 AS risk"),
        "files": mine.selectExpr("file", "k * 3 % 200 AS lines"),
        "links": mine.where("k % 6 = 0").selectExpr("file", "concat('f', k) AS symbol", "'commit' AS source_type", "concat('abcdef0', k, 'x') AS ref"),
        "edges": s.selectExpr(f"{_PATH} AS item_a", f"{path(1)} AS item_b", "0.6 + (k % 5) / 10 AS rate", "k % 8 AS support"),
        "rules": s.selectExpr("concat('f', k) AS symbol_a", f"{_PATH} AS file_a", "concat('f', k + 2) AS symbol_b", f"{path(2)} AS file_b", "k % 6 AS shared", "(k % 10) / 10 AS confidence"),
        "siblings": mine.where("k % 7 = 0").selectExpr("file", "concat('g', k) AS symbol"),
        "guards": both.where("q = 50").selectExpr("change", "file", "'assert x' AS guard").distinct(),
        "boundaries": both.where("q = 49").selectExpr("change", "file", "'<' AS old_op", "'<=' AS new_op").distinct(),
        "fragility": mine.selectExpr("file", "explode(array(concat('f', k), concat('g', k))) AS symbol", "k % 5 AS score"),
        "feedback": mine.where("k % 11 = 0").selectExpr("'all' AS finding_type", "file", "'' AS symbol").unionByName(mine.where("k % 14 = 0").selectExpr("'sibling' AS finding_type", "file", "concat('g', k) AS symbol")).unionByName(mine.where("k % 13 = 0").selectExpr("'invariant' AS finding_type", "file", "'' AS symbol")),
    }


_SQL = f"""s AS (SELECT s_suppkey AS k, {_PATH} AS file FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)),
l AS (SELECT l_orderkey AS change, k, {_PATH} AS file, q FROM (SELECT l_orderkey, l_suppkey AS k, l_quantity AS q FROM lineitem)),
c AS (SELECT DISTINCT change, k, file FROM l),
e AS (SELECT k AS a, k + 1 AS b, 0.6::DOUBLE + (k % 5) / 10 AS score FROM s WHERE 0.6::DOUBLE + (k % 5) / 10 >= 0.7 AND k % 8 >= 4),
w AS (SELECT a, b, score FROM e UNION SELECT b, a, score FROM e),
p AS (SELECT k, {_PATH} AS path FROM (SELECT DISTINCT k + d AS k FROM s, (SELECT unnest([0, 1, 2]) AS d))),
found AS (
SELECT change, 'hotspot' AS kind, CASE WHEN k % 6 > 0 AND k % 40 >= 15 AND (k * 3 % 200 >= 50 OR k * 3 % 200 = 0) THEN 'warning' ELSE 'note' END AS severity, file, k, NULL AS symbol, (k % 6 = 0)::INT::VARCHAR AS other, (k % 10) / 10 AS score, NULL AS note FROM c WHERE k % 10 >= 5 AND k % 40 >= 10 AND k % 4 <> 1
UNION ALL SELECT change, 'co_change', 'warning', file, c.k, NULL, path, score, NULL FROM c JOIN w ON w.a = c.k JOIN p ON p.k = w.b WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.change = c.change AND d.k = w.b)
UNION ALL SELECT change, 'rule', 'warning', file, c.k, 'f' || c.k, path, (c.k % 10) / 10, 'f' || (c.k + 2) FROM c JOIN p ON p.k = c.k + 2 WHERE c.k % 10 >= 5 AND c.k % 6 >= 3 AND NOT EXISTS (SELECT 1 FROM c AS d WHERE d.change = c.change AND d.k = c.k + 2)
UNION ALL SELECT change, 'test_coupling', 'warning', min(file) FILTER (k % 4 IN (0, 3)), NULL, NULL, (count(*) FILTER (k % 4 IN (0, 3)))::VARCHAR, NULL, NULL FROM c GROUP BY change HAVING count(*) FILTER (k % 4 IN (0, 3)) > 0 AND count(*) FILTER (k % 4 = 2) = 0
UNION ALL SELECT change, 'sibling', 'warning', file, k, 'g' || k, NULL, NULL, NULL FROM c WHERE k % 7 = 0
UNION ALL SELECT DISTINCT change, 'invariant', 'critical', file, k, NULL, NULL, NULL::DOUBLE, 'assert x' FROM l WHERE q = 50
UNION ALL SELECT DISTINCT change, 'boundary', 'note', file, k, NULL, NULL, NULL::DOUBLE, '< -> <=' FROM l WHERE q = 49
UNION ALL SELECT change, 'fragile', 'warning', file, k, n || k, NULL, (k % 5)::DOUBLE, NULL FROM c, (SELECT unnest(['f', 'g']) AS n) WHERE k % 5 >= 2
UNION ALL SELECT change, 'link', 'note', file, k, 'f' || k, 'commit', NULL, substr('abcdef0' || k || 'x', 1, 8) FROM c WHERE k % 6 = 0),
kept AS (SELECT change, kind, severity, file, symbol, other, score, note FROM found WHERE NOT coalesce((kind IN ('invariant', 'co_change') AND k % 11 = 0) OR (kind = 'sibling' AND k % 14 = 0) OR (kind = 'invariant' AND k % 13 = 0), false))"""


@query(f"WITH {_SQL} SELECT change, kind, severity, file, symbol, other, round(score, 6) AS score, note FROM kept")
def change_check(spark, sf):
    """All findings of all orders."""
    given = _inputs(spark, sf)
    return change.change_check(given.pop("changed"), **given).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SQL} SELECT change, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings, coalesce(critical, 0) + coalesce(warnings, 0) > 0 AS failed FROM (SELECT DISTINCT change FROM c) LEFT JOIN (
SELECT change, count(*) FILTER (kind = 'invariant') AS critical, count(*) FILTER (kind IN ('sibling', 'co_change', 'rule', 'test_coupling')) AS warnings FROM kept GROUP BY change) USING (change)""")
def change_gate(spark, sf):
    """Which orders a check that fails on warnings lets through."""
    given = _inputs(spark, sf)
    changed = given.pop("changed")
    return change.gate(changed, change.change_check(changed, **given), "warning")


_INTENT = """i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE round((c_custkey % 10) / 10, 6) END AS score, coalesce(round((c_custkey % 10) / 10, 6), 0.7) AS s FROM customer),
a AS (SELECT o_custkey AS k, count(*) AS sessions, sum(o_orderkey % 4) AS commits FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-05-16' AND TIMESTAMP '1998-06-15' GROUP BY 1),
r AS (SELECT k, CASE WHEN k % 6 = 5 THEN 0.7 ELSE s END::DOUBLE AS before, ((k % 7) / 7)::DOUBLE AS after, k % 12 = 0 AS weak, sessions, commits FROM i JOIN a USING (k) WHERE k % 3 < 2)"""


def _consolidated(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    name = F.concat(F.lit("f"), F.col("k").cast("string")).alias("file")
    intents = c.select(name, F.when(F.col("k") % 6 != 5, F.round(F.col("k") % 10 / 10, 6)).alias("score"))
    activity = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 4).alias("commits"))
    judged = c.where("k % 3 < 2").select(name, (F.col("k") % 7 / 7).alias("score"), (F.col("k") % 12 == 0).alias("weakening"))
    return ingest.consolidate(intents, activity, judged, "1998-06-15 00:00:00")


@query(f"WITH {_INTENT} SELECT 'f' || k AS file, round(after, 6) AS score, sessions, commits::BIGINT AS commits FROM r")
def intent_history(spark, sf):
    """Scores of the files that were worked on in thirty days."""
    return _consolidated(spark, sf)[0].withColumn("score", F.round("score", 6))


@query(f"""WITH {_INTENT}, d AS (SELECT *, CASE WHEN before > 0 THEN (before - after) / before ELSE 0 END AS fall FROM r)
SELECT 'f' || k AS file, round(before, 6) AS before, round(after, 6) AS after, round(100 * fall, 1) AS drop FROM d WHERE fall > 0.2 OR weak""")
def silent_weakening(spark, sf):
    return _consolidated(spark, sf)[1].select("file", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "drop")


@query(f"WITH {_INTENT} SELECT 'f' || i.k AS file, round(CASE WHEN abs(after - before) > 0.1 THEN after ELSE score END, 6) AS score FROM i LEFT JOIN r ON r.k = i.k")
def intent_update(spark, sf):
    return _consolidated(spark, sf)[2].withColumn("score", F.round("score", 6))


@query("""SELECT 'f' || c_custkey AS symbol, 'webhook_adr' AS source_type, 'adr/webhook_20240203_040506_' || substr(md5(c_custkey || ':' || n), 1, 8) || '.md' AS ref, 1.0::DOUBLE AS confidence, CASE n WHEN 0 THEN 'Keep' ELSE 'Design Rule' END AS text, CASE n WHEN 0 THEN 'a.py' ELSE 'global' END AS file, 'rule ' || c_custkey AS rule
FROM customer, (SELECT unnest([0, 1]) AS n) WHERE c_custkey % 2 = 0""")
def webhook_rules(spark, sf):
    """Rules in what a model answered to each customer's event: two, one without a description, or nothing."""
    both = F.expr("concat('Sure:\\n{\"rules\": [{\"target_file\": \"a.py\", \"symbol_name\": \"f', id, '\", \"rule_title\": \"Keep\", \"rule_description\": \"rule ', id, '\"}, {\"symbol_name\": \"f', id, '\", \"rule_description\": \"rule ', id, '\"}]}')")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    none = F.when(F.col("id") % 4 == 1, F.lit('{"rules": [{"symbol_name": "x"}]}')).otherwise("nothing {")
    return ingest.rules(rows.select("id", F.to_timestamp(F.lit("2024-02-03 04:05:06")).alias("at"), F.when(F.col("id") % 2 == 0, both).otherwise(none).alias("answer")))
