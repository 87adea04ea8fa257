"""Source files that Spark derives from the supplier table, and the code operators over them.

A supplier k is a file, in Python, TypeScript or Go by k % 3. Its function fk hands its argument to that of the next
supplier of its ring: five by five, in a circle. Some files have a dangerous call (k % 4 = 1), some a function that reads
outside input (k % 5 = 0, or a balance below 1000), some hand on a constant instead (k % 5 = 2), and some have a test (k % 6 = 0).
The files are written as a table, which the operators read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import code, conventions, flows
from cairn.operators import audit, blame as B, closure, contain, imports, taint
from cairn.plans.fixture import query
from cairn.session import stored, table
from cairn.sources import history

_PY = "concat('import os\n\n\ndef f', k, '(x):\n    y = x\n', IF(sink, '    os.system(y)\n', ''), '    return f', next, IF(cut, '(\\'k\\')\n', '(y)\n'), IF(source, concat('\n\ndef start', k, '(request):\n    return f', k, '(request.args[\\'q\\'])\n'), ''))"
_TS = "concat('import { f', next, ' } from \\'./f', next, '\\';\n\nexport function f', k, '(x: string) {\n  const y = `a $', '{x}`;\n', IF(sink, '  exec(y);\n', ''), '  return f', next, IF(cut, '(\\'k\\');\n}\n', '(y);\n}\n'), IF(source, concat('\nexport const start', k, ' = (req) => f', k, '(req.query.q);\n'), ''))"
_GO = "concat('package src\n\nimport \"os/exec\"\n\nfunc f', k, '(x string) string {\n\ty := x\n', IF(sink, '\texec.Command(y)\n', ''), '\treturn f', next, IF(cut, '(\"k\")\n}\n', '(y)\n}\n'), IF(source, concat('\nfunc start', k, '(r *http.Request) string {\n\treturn f', k, '(r.FormValue(\"q\"))\n}\n'), ''))"


def files(spark, sf: str) -> DataFrame:
    """path, code."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), ((F.col("s_acctbal") < 1000) | (F.col("s_suppkey") % 5 == 0)).alias("source"))
    s = s.withColumn("ring", F.expr("k div 5"))
    ring = Window.partitionBy("ring").orderBy("k")
    s = s.withColumn("next", F.coalesce(F.lead("k").over(ring), F.first("k").over(ring)))
    s = s.selectExpr("k", "next", "source", "k % 4 = 1 AS sink", "k % 5 = 2 AS cut")
    made = s.select(F.expr("concat('src/f', k, element_at(array('.py', '.ts', '.go'), cast(k % 3 + 1 AS int)))").alias("path"), F.expr(f"CASE k % 3 WHEN 0 THEN {_PY} WHEN 1 THEN {_TS} ELSE {_GO} END").alias("code"))
    tests = s.where("k % 6 = 0").selectExpr("concat('tests/test_f', k, '.py') AS path", "concat('from src import f', k, '\n\n\ndef test_f', k, '():\n    assert f', k, '(1)\n') AS code")
    return stored(made.unionByName(tests), "files")


_SQL = """RECURSIVE s AS (SELECT s_suppkey AS k, s_acctbal < 1000 OR s_suppkey % 5 = 0 AS source, s_suppkey % 4 = 1 AS sink, s_suppkey % 5 = 2 AS cut, s_suppkey // 5 AS ring FROM supplier),
f AS (SELECT *, coalesce(lead(k) OVER w, first(k) OVER w) AS next, count(*) OVER (PARTITION BY ring) AS size, 'src/f' || k || CASE k % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS path,
  CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 5 END + sink::INT AS ln FROM s WINDOW w AS (PARTITION BY ring ORDER BY k))"""
#: Lines: a function begins at `ln - sink`, has two lines more, one more with a sink, and one more for its brace.


@query(f"""WITH {_SQL}, walk AS (SELECT k AS a, k AS b, 1 AS hops, 'start' || k || '>f' || k AS via, path AS source_path FROM f WHERE source
  UNION ALL SELECT a, f.next, hops + 1, via || '>f' || f.next, source_path FROM walk JOIN f ON b = f.k WHERE NOT f.cut AND hops < f.size)
SELECT source_path, 'start' || a AS source_function, path AS sink_path, 'f' || b AS sink_function, CASE b % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'exec' ELSE 'exec.Command' END AS sink,
  (CASE b % 3 WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 7 END)::BIGINT AS line, hops::BIGINT AS hops, via FROM walk JOIN f ON b = f.k WHERE f.sink""")
def taint_flows(spark, sf):
    """Outside input that reaches a dangerous call through the functions of a ring."""
    return taint.taint_flows(files(spark, sf))


@query(f"""WITH {_SQL}, d AS (
SELECT k, path, 'f' || k AS name, ln - sink::INT AS start, ln - sink::INT + 2 + sink::INT + (k % 3 > 0)::INT AS "end",
  CASE k % 3 WHEN 0 THEN 'def f' || k || '(x):' WHEN 1 THEN 'export function f' || k || '(x: string) {{' ELSE 'func f' || k || '(x string) string {{' END AS signature,
  CASE WHEN k % 3 = 0 THEN array_to_string(list_sort(list_filter(['f' || next, CASE WHEN sink THEN 'system' END], lambda x: x IS NOT NULL)), ',') ELSE CASE WHEN sink THEN CASE k % 3 WHEN 1 THEN 'exec,' ELSE 'Command,' END ELSE '' END || 'f' || next END AS calls FROM f
UNION ALL SELECT k, path, 'start' || k, ln - sink::INT + 2 + sink::INT + CASE k % 3 WHEN 0 THEN 3 ELSE 3 END, ln - sink::INT + 2 + sink::INT + CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 5 END,
  CASE k % 3 WHEN 0 THEN 'def start' || k || '(request):' WHEN 1 THEN 'export const start' || k || ' = (req) => f' || k || '(req.query.q);' ELSE 'func start' || k || '(r *http.Request) string {{' END,
  'f' || k || CASE WHEN k % 3 = 2 THEN ',FormValue' ELSE '' END FROM f WHERE source
UNION ALL SELECT k, 'tests/test_f' || k || '.py', 'test_f' || k, 4, 5, 'def test_f' || k || '():', 'f' || k FROM f WHERE k % 6 = 0)
SELECT path, name, 'function' AS kind, start::BIGINT AS start, "end"::BIGINT AS "end", signature, calls FROM d""")
def file_symbols(spark, sf):
    """Definitions of all files, in three languages."""
    return flows.file_symbols(files(spark, sf)).select("path", "name", "kind", "start", "end", "signature", F.array_join("calls", ",").alias("calls"))


@query(f"WITH {_SQL} SELECT path, CASE k % 3 WHEN 1 THEN './f' || next ELSE 'exec' END AS alias, CASE k % 3 WHEN 1 THEN './f' || next ELSE 'os/exec' END AS module FROM f WHERE k % 3 > 0")
def file_imports(spark, sf):
    return flows.file_imports(files(spark, sf))


@query(f"""WITH {_SQL} SELECT path, name, 'function' AS kind, start::BIGINT AS start, "end"::BIGINT AS "end", is_source, calls FROM (
SELECT path, 'f' || k AS name, 4 AS start, 6 + sink::INT AS "end", false AS is_source, array_to_string(list_sort(list_filter(['f' || next, CASE WHEN sink THEN 'system' END], lambda x: x IS NOT NULL)), ',') AS calls FROM f WHERE k % 3 = 0
UNION ALL SELECT path, 'start' || k, 9 + sink::INT, 10 + sink::INT, true, 'f' || k FROM f WHERE k % 3 = 0 AND source
UNION ALL SELECT 'tests/test_f' || k || '.py', 'test_f' || k, 4, 5, false, 'f' || k FROM f WHERE k % 6 = 0)""")
def extract_symbols(spark, sf):
    """Definitions of the Python files."""
    return code.extract_symbols(files(spark, sf)).select("path", "name", "kind", "start", "end", "is_source", F.array_join("calls", ",").alias("calls"))


@query(f"WITH {_SQL} SELECT path, 'f' || k AS function, 'y' AS variable, 'system' AS sink, 6::BIGINT AS line FROM f WHERE k % 3 = 0 AND sink")
def python_taint(spark, sf):
    """Parameters that reach a dangerous call in their own function."""
    return code.python_taint(files(spark, sf))


@query(f"""WITH {_SQL} SELECT path, 'import os' || chr(10) || chr(10) || 'def f' || k || '(x):' || chr(10) || '    ...' || CASE WHEN source THEN chr(10) || chr(10) || 'def start' || k || '(request):' || chr(10) || '    ...' ELSE '' END AS code FROM f WHERE k % 3 = 0
UNION ALL SELECT 'tests/test_f' || k || '.py', 'from src import f' || k || chr(10) || chr(10) || 'def test_f' || k || '():' || chr(10) || '    ...' FROM f WHERE k % 6 = 0""")
def skeletonize(spark, sf):
    return code.skeletonize(files(spark, sf).where("path LIKE '%.py'"))


@query(f"WITH {_SQL} SELECT path, 'tests/test_f' || k || '.py' AS test FROM f WHERE k % 6 = 0")
def related_tests(spark, sf):
    """Test files whose functions call a file's."""
    rows = flows.file_symbols(files(spark, sf))
    calls = rows.where("name LIKE 'test%'").select(F.col("path").alias("test"), F.explode("calls").alias("name"))
    return rows.where("name NOT LIKE 'test%'").select("path", "name").join(calls, "name").select("path", "test").distinct()


@query("""WITH a AS (SELECT 'bots/b' || s_suppkey || '.py' AS path, s_suppkey AS k FROM supplier)
SELECT path, 'framework' AS kind, CASE k % 7 WHEN 0 THEN 'transformers' ELSE 'openai' END AS name FROM a WHERE k % 7 < 2
UNION ALL SELECT path, 'prompt', 'SYSTEM_PROMPT' FROM a WHERE k % 2 = 0 UNION ALL SELECT path, 'gate', 'ask_user' FROM a WHERE k % 9 = 0""")
def ai_assets(spark, sf):
    """Model libraries, prompts and human gates, in a file for each supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    body = "concat(IF(k % 7 = 0, 'import transformers\n', IF(k % 7 = 1, 'from openai import x\n', '')), IF(k % 2 = 0, 'SYSTEM_PROMPT = 1\n', ''), 'def run(x):\n    return ', IF(k % 9 = 0, 'ask_user(x)', 'x'), '\n')"
    return conventions.ai_assets(s.selectExpr("concat('bots/b', k, '.py') AS path", f"{body} AS code"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS ring FROM supplier),
g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (k % 5 <> 2) OVER w AS guarded FROM s WINDOW w AS (PARTITION BY ring))
SELECT 'api/r' || ring || '.py' AS path, 'put_' || k AS name FROM g WHERE n >= 3 AND guarded >= 0.7 * n AND k % 5 = 2""")
def sibling_conventions(spark, sf):
    """Functions without the check that their file's others begin with; a file holds five suppliers."""
    one = table(spark, sf, "supplier").selectExpr("s_suppkey div 5 AS ring", "concat('def put_', s_suppkey, '(x):\\n', IF(s_suppkey % 5 = 2, '', '    assert isinstance(x, int)\\n'), '    return x\\n\\n') AS body")
    made = one.groupBy("ring").agg(F.array_join(F.collect_list("body"), "").alias("code"))  # five at most
    return conventions.unguarded(made.selectExpr("concat('api/r', ring, '.py') AS path", "code"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS ring FROM supplier), n AS (SELECT *, lead(k) OVER w AS next, first(k) OVER w AS head FROM s WINDOW w AS (PARTITION BY ring ORDER BY k)),
u AS (SELECT ring, 'f' || k AS name, 'f' || coalesce(next, head) AS used FROM n WHERE k % 5 <> 3 UNION ALL SELECT ring, 'f' || k, 'LIMIT' FROM n UNION ALL SELECT ring, 'K', 'f' || k FROM n WHERE k % 5 = 4),
c AS (SELECT DISTINCT ring, 'f' || head AS name FROM n UNION SELECT ring, 'gone' FROM s UNION SELECT ring, used FROM c JOIN u USING (ring, name))
SELECT 'lib/r' || ring || '.py' AS path, name FROM c""")
def dependency_closure(spark, sf):
    """What the first function of each file needs of it. A file holds five suppliers' functions, a constant and a class; each
    function calls the next, in a circle, but for one that calls none."""
    one = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).selectExpr("k", "k div 5 AS ring")
    ring = Window.partitionBy("ring").orderBy("k")
    one = one.withColumn("next", F.coalesce(F.lead("k").over(ring), F.first("k").over(ring)))
    one = one.selectExpr("ring", "concat('def f', k, '(self):\n    return LIMIT', IF(k % 5 = 3, '', concat(' + f', next, '(self)')), '\n\n', IF(k % 5 = 4, concat('class K:\n    x = f', k, '\n\n'), '')) AS body")
    made = one.groupBy("ring").agg(F.concat(F.lit("import os\n\nLIMIT = 1\nSPARE = LIMIT\n\n"), F.array_join(F.collect_list("body"), "")).alias("code"))  # five at most
    initial = table(spark, sf, "supplier").groupBy(F.expr("s_suppkey div 5").alias("ring")).agg(F.min("s_suppkey").alias("k"))
    initial = initial.selectExpr("concat('lib/r', ring, '.py') AS path", "explode(array(concat('f', k), 'gone')) AS name")
    return closure.dependency_closure(code.name_uses(made.selectExpr("concat('lib/r', ring, '.py') AS path", "code")), initial)


# ---- histories: an order is a commit of its customer's file. The first of a file writes five lines; each other takes one of
# lines 2 to 4 for two of its own, and line 5 for none to two.

_COMMITS = "o AS (SELECT o_orderkey AS c, o_custkey AS f, o_orderdate AS day, o_orderstatus AS who, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM orders)"
_REPLAY = f"""RECURSIVE {_COMMITS}, w AS (SELECT f, 1::BIGINT AS s, [c, c, c, c, c] AS l FROM o WHERE s = 1
UNION ALL SELECT w.f, o.s, list_concat(list_concat(list_concat(l[1:c % 3 + 1], [c, c]), l[c % 3 + 3:4]), list_concat(CASE c % 3 WHEN 0 THEN [] WHEN 1 THEN [c] ELSE [c, c] END, l[6:])) FROM w JOIN o ON o.f = w.f AND o.s = w.s + 1),
last AS (SELECT f, arg_max(l, s) AS l FROM w GROUP BY f), n AS (SELECT f, unnest(l) AS c, unnest(generate_series(1, len(l))) AS i FROM last)"""


def _log(spark, sf) -> DataFrame:
    """A commit a row, as git prints it without context."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("c"), F.col("o_custkey").alias("f"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("who"))
    o = o.withColumn("s", F.row_number().over(Window.partitionBy("f").orderBy("at", "c")))
    head = "concat(c, '|', date_format(at, 'yyyy-MM-dd'), '|', who, '|change ', c, '\n\ndiff --git a/f', f, '.py b/f', f, '.py\n--- ', IF(s = 1, '/dev/null', concat('a/f', f, '.py')), '\n+++ b/f', f, '.py\n')"
    first = "concat('@@ -0,0 +1,5 @@\n', repeat('+x\n', 5))"
    other = "concat('@@ -', c % 3 + 2, ' +', c % 3 + 2, ',2 @@\n-x\n+++ b/y\n+@@ -1 +1 @@\n@@ -5 +', IF(c % 3 = 0, '5,0', IF(c % 3 = 1, '6', '6,2')), ' @@ def x\n-x\n', repeat('+x\n', cast(c % 3 AS int)))"
    return o.selectExpr(f"concat({head}, IF(s = 1, {first}, {other})) AS value")


@query(f"""WITH {_COMMITS} SELECT c::VARCHAR AS commit, strftime(day, '%Y-%m-%d') AS "at", who AS author, 'change ' || c AS subject, 'f' || f || '.py' AS file, h[1]::BIGINT AS old_start, h[2]::BIGINT AS old_lines, h[3]::BIGINT AS start, h[4]::BIGINT AS lines FROM (
SELECT *, unnest(CASE WHEN s = 1 THEN [[0, 0, 1, 5]] ELSE [[c % 3 + 2, 1, c % 3 + 2, 2], [5, 1, CASE c % 3 WHEN 0 THEN 5 ELSE 6 END, c % 3]] END) AS h FROM o)""")
def hunk_log(spark, sf):
    return history.hunk_log(_log(spark, sf))


def _blamed(spark, sf) -> DataFrame:
    hunks = history.hunk_log(_log(spark, sf)).selectExpr("file", "struct(at, cast(commit AS long) AS c) AS at", "commit", "old_start", "old_lines", "lines AS new_lines")
    return B.blame(hunks.withColumn("at", F.concat(F.col("at.at"), F.lpad(F.col("at.c").cast("string"), 12, "0"))))


@query(f"""WITH {_REPLAY} SELECT 'f' || f || '.py' AS file, min(i)::BIGINT AS start, max(i)::BIGINT AS "end", c::VARCHAR AS commit FROM (SELECT *, i - row_number() OVER (PARTITION BY f, c ORDER BY i) AS run FROM n) GROUP BY f, c, run""")
def blame(spark, sf):
    """The commit of each line, from the hunks of the log."""
    return _blamed(spark, sf)


@query(f"""WITH {_REPLAY} SELECT DISTINCT 'f' || f || '.py' AS file, CASE WHEN i <= 3 THEN 'head' ELSE 'rest' END AS symbol, c::VARCHAR AS commit FROM n WHERE i <= 18""")
def blamed_symbols(spark, sf):
    """Commits of the first fifteen lines of two symbols of each file: lines 1 to 3, and from 4."""
    places = table(spark, sf, "orders").select(F.expr("concat('f', o_custkey, '.py')").alias("file")).distinct()
    symbols = places.select("file", F.expr("explode(array(struct('head' AS symbol, 1L AS start, 3L AS `end`), struct('rest' AS symbol, 4L AS start, 900L AS `end`)))").alias("s")).select("file", "s.*")
    return B.commits_of(_blamed(spark, sf), symbols)


# ---- mentions and containment


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), m AS (
SELECT 'f' || k AS symbol, 'ADR-' || k % 9 AS ref, 'ADR-' || k % 9 || ': keep' AS text FROM s WHERE k % 2 = 0
UNION ALL SELECT 'f' || k, 'HOTSPOT', 'Hotspot here' FROM s WHERE k % 2 = 0
UNION ALL SELECT 'C', 'DO NOT MODIFY', 'do not  modify ' || (SELECT arg_min(k, 'm/a' || k || '.py') FROM s WHERE k % 2 = 0) FROM s WHERE k % 2 = 0
UNION ALL SELECT 'm/a' || k || '.ts', 'DECISION:USE-' || k, 'decision:use-' || k || ' always' FROM s WHERE k % 2 = 1)
SELECT DISTINCT symbol, 'mention' AS source_type, ref, 0.95::DOUBLE AS confidence, text FROM m""")
def mention_links(spark, sf):
    """Comments that name decisions, in a Python or TypeScript file for each supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    py = s.where("k % 2 = 0").selectExpr("concat('m/a', k, '.py') AS path", "concat('# ADR-', k % 9, ': keep\ndef f', k, '(x):\n    y = x\n    return y  # Hotspot here\n\n\nclass C:\n    a = 1\n    # do not  modify ', k, '\n    b = 2\n') AS code")
    ts = s.where("k % 2 = 1").selectExpr("concat('m/a', k, '.ts') AS path", "concat('// decision:use-', k, ' always\nfunction g() {}\n') AS code")
    made = py.unionByName(ts)
    return audit.mention_links(made, flows.file_symbols(made).withColumnRenamed("name", "symbol"))


@query("""WITH n AS (SELECT '/EN/' || s_suppkey AS needle FROM supplier UNION SELECT substr(n_name, 1, 2) FROM nation UNION SELECT '7')
SELECT DISTINCT url AS text, needle FROM pages JOIN n ON contains(lower(url), lower(needle))""")
def contained(spark, sf):
    """Addresses that contain words of two other tables, whatever the case."""
    words = table(spark, sf, "supplier").selectExpr("concat('/EN/', s_suppkey) AS needle").union(table(spark, sf, "nation").selectExpr("substr(n_name, 1, 2)")).union(table(spark, sf, "region").selectExpr("'7'"))
    return contain.contains_join(table(spark, sf, "pages").withColumnRenamed("url", "text"), words, fold=True)


@query("SELECT p_partkey AS id, p_partkey % 7 = 0 OR p_size * 3 < 50 AS trivial FROM part")
def trivial_files(spark, sf):
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "/version.py").otherwise("/main.py"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), audit.is_trivial(path, F.col("p_size") * 3).alias("trivial"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, 'src/a' || k % 10 || '/m' || k || CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.tsx' END AS path FROM p)
SELECT a.path, '../' || (CASE a.k % 3 WHEN 1 THEN '../' ELSE '' END) || 'a' || b.k % 10 || '/m' || b.k AS module, b.path AS target FROM f AS a JOIN f AS b ON b.k = a.k + 1
UNION ALL SELECT 'lib/a' || k || '.py', 'pkg' || k % 7 || '.n' || (k + 7), 'lib/pkg' || k % 7 || '/n' || (k + 7) || '.py' FROM p WHERE k + 7 IN (SELECT k FROM p)""")
def resolved_imports(spark, sf):
    """Relative imports of each part's next, and package imports in Python, to the files they mean."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    tail = "CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.tsx' END"
    ts = p.selectExpr(f"concat('src/a', k % 10, '/m', k, {tail}) AS path", "concat('../', IF(k % 3 = 1, '../', ''), 'a', (k + 1) % 10, '/m', k + 1) AS module")
    py = p.selectExpr("concat('lib/a', k, '.py') AS path", "concat('pkg', k % 7, '.n', k + 7) AS module")
    files = ts.select("path").union(py.select("path")).union(p.selectExpr("concat('lib/pkg', k % 7, '/n', k, '.py')"))
    return imports.resolve(ts.unionByName(py), files)
