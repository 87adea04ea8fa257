"""Bundles under a budget, bound to the test tables: a nation asks for its suppliers, a vector for vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import bundles
from cairn.plans.fixture import query
from cairn.session import stored, table


@query()
def best_first(spark, sf):
    """For every twentieth vector, a bundle that begins with its three next and follows the next three of a label."""
    e = table(spark, sf, "embeddings").withColumn("id", F.format_string("%09d", "vec_id"))
    by = Window.partitionBy("label").orderBy("vec_id")
    near = stored(e.select("vec_id", "id", F.array(*(F.lead("id", k).over(by) for k in (1, 2, 3))).alias("next")), "near")
    deps = near.select(F.col("id").alias("src"), F.explode("next").alias("dst")).where("dst IS NOT NULL")
    questions = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    seeds = near.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.explode("next").alias("id")).where("id IS NOT NULL")
    symbols = e.select("id", F.col("embedding").alias("vector"), (20 + F.col("label") % 7).cast("long").alias("tokens"))
    return bundles.best_first(seeds, deps, questions, symbols, 200, least=0.1)


_ASK = """s AS (SELECT s_suppkey AS k, s_nationkey AS q, s_acctbal AS b FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY b DESC, k) AS rank FROM s)"""


def _ranked(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("question"), F.col("s_acctbal").alias("b"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("b"), "k")))


@query(f"""WITH RECURSIVE {_ASK}, z AS (SELECT k, CASE WHEN k % 10 = 3 THEN 200 ELSE 20 + k % 30 END::BIGINT AS a, 8 + k % 5 AS b, 3 AS c FROM s),
t AS (SELECT q, lpad(k::VARCHAR, 9, '0') AS id, 0 AS a, rank AS b, '' AS c FROM r WHERE rank <= 2 UNION ALL SELECT q, lpad(k::VARCHAR, 9, '0'), 2, rank, '' FROM r WHERE rank > 2
  UNION ALL SELECT q, lpad((k + d)::VARCHAR, 9, '0'), 1, rank, lpad((k + d)::VARCHAR, 9, '0') FROM r, (SELECT unnest([1, 4]) AS d) WHERE rank <= 2),
u AS (SELECT q, id, min((a, b, c)) AS turn FROM t GROUP BY q, id), o AS (SELECT u.q, u.id, z.a, z.b, z.c, turn[1] = 0 AS must, row_number() OVER (PARTITION BY u.q ORDER BY turn, u.id) AS n FROM u JOIN z ON z.k = u.id::BIGINT),
f AS (SELECT q, 0::BIGINT AS n, '' AS id, 0 AS level, 0::BIGINT AS tokens, 0::BIGINT AS spent FROM (SELECT DISTINCT q FROM s)
  UNION ALL SELECT q, n, id, level, tokens, spent + coalesce(tokens, 0) FROM (
    SELECT *, CASE level WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c END AS tokens FROM (
      SELECT f.q, o.n, o.id, f.spent, a, b, c, CASE WHEN must THEN (a > 120)::INT WHEN spent + a <= 80 THEN 0 WHEN spent + b <= 80 THEN 1 WHEN spent + c <= 80 THEN 2 END AS level FROM f JOIN o ON o.q = f.q AND o.n = f.n + 1)))
SELECT q AS question, id, level::BIGINT AS level, tokens, spent FROM f WHERE n > 0 AND level IS NOT NULL""")
def two_pass(spark, sf):
    """A nation's suppliers under a budget of 80, in full, in short or in a line; supplier k depends on k + 1 and k + 4."""
    ranked = _ranked(spark, sf).withColumn("id", F.format_string("%09d", "k"))
    deps = ranked.select(F.col("id").alias("src"), F.explode(F.array(F.format_string("%09d", F.col("k") + 1), F.format_string("%09d", F.col("k") + 4))).alias("dst"))
    sizes = ranked.select("id", F.array(F.when(F.col("k") % 10 == 3, 200).otherwise(20 + F.col("k") % 30), 8 + F.col("k") % 5, F.lit(3)).alias("sizes"))
    return bundles.two_pass(bundles.reading_order(ranked, deps), sizes, 80)


@query(f"""WITH {_ASK}, w AS (SELECT q, k, row_number() OVER (PARTITION BY q, k % 3 ORDER BY b, k) AS rank FROM s), v AS (SELECT q, k, rank FROM r)
SELECT q AS question, k AS id, round(sum(p), 9) AS score FROM (SELECT q, k, 1 / (60 + rank)::DOUBLE AS p FROM w WHERE rank <= 2 UNION ALL SELECT q, k, 0.6::DOUBLE / (60 + rank) FROM v WHERE rank <= 3) GROUP BY q, k""")
def pooled(spark, sf):
    """Three word queries of a nation and its nearest suppliers, by reciprocal rank."""
    ranked = _ranked(spark, sf).withColumnRenamed("k", "id")
    words = ranked.withColumn("query", F.col("id") % 3).withColumn("rank", F.row_number().over(Window.partitionBy("question", "query").orderBy("b", "id")))
    return bundles.pooled(words, ranked, each=2, most=3)


@query(f"""WITH {_ASK} SELECT q AS question, arg_max(k % 3 = 0 AND k % 9 < 5, (0.001 * (k % 9), k)) AS low FROM s GROUP BY q""")
def low_confidence(spark, sf):
    s = _ranked(spark, sf).select("question", F.col("k").alias("id"), (0.001 * (F.col("k") % 9)).alias("score"), F.when(F.col("k") % 3 > 0, 0.5).alias("semantic"))
    return bundles.low_confidence(s)
