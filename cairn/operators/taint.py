"""Outside input followed from function to function, over files and languages.

cairn.functions.flows says what happens inside each function. Here the facts of all files are joined along calls:

1. A call is of the functions of its name in its own file, else of those in all files. It hands argument k to parameter k
   (after `self` or `cls`), and a named argument to the parameter of that name.
2. Summaries (parameter → return, source → return) and what reaches each function's targets grow together, a round of joins
   at a time, until nothing is added: the result of a call is what those of its arguments bring that its function returns;
   a call of unknown functions hands on all of them.
3. What a function's source reaches in arguments taints parameters, and those taint others: shortest paths over the
   parameters, by cairn.operators.graph.

The number of rounds is that of nested calls, not of files; recursion ends because each fact is kept once. Hot names are
joined by name, which adaptive plans split; all joins are equal joins and every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.flows import SOURCE, flow_facts
from cairn.operators.graph import taint_paths
from cairn.session import stored


def bindings(facts: DataFrame) -> DataFrame:
    """fid, call, to (the fid of each function that the call may be of, null if there is none), params of that."""
    defs = facts.where("kind = 'def' AND function != '(module)'").select(F.col("path").alias("to_path"), F.col("function").alias("callee"), F.col("fid").alias("to"), "params").distinct()
    calls = facts.where("kind = 'call'").select("fid", "path", "call", "callee").distinct()
    own = calls.join(defs, (calls["path"] == defs["to_path"]) & (calls["callee"] == defs["callee"])).select(calls["fid"], "call", "to", "params")
    rest = calls.join(own.select("fid", "call").distinct(), ["fid", "call"], "left_anti")
    return own.unionByName(rest.join(defs, "callee", "left").select("fid", "call", "to", "params"))


def _given(args: DataFrame, bound: DataFrame) -> DataFrame:
    """fid, call, target (an argument), to, p: the parameter that each argument is given to; to and p are null, if no
    function is known."""
    offset = F.when(F.col("params")[0].isin("self", "cls"), 1).otherwise(0)
    named = F.array_position("params", F.col("name")) - 1
    p = F.when(F.col("name").isNotNull(), named).otherwise(F.col("arg") + offset).cast("long")
    out = args.select("fid", "call", "target", "arg", "name").distinct().join(bound, ["fid", "call"]).withColumn("p", F.when(F.col("to").isNotNull(), p))
    return out.where("to IS NULL OR (p >= 0 AND p < size(params))").select("fid", "call", "target", "to", "p")


def reach(facts: DataFrame, bound: DataFrame, given: DataFrame) -> DataFrame:
    """fid, origin (source or a parameter), target: all that each function's own input and parameters reach in it."""
    local = facts.where("origin IS NOT NULL").select("fid", "origin", "target").distinct()
    results = stored(local.where("origin LIKE 'r:%'").select("fid", F.expr("substring(origin, 3)").alias("call"), "target"), "taint-results")
    known = stored(local.where("origin NOT LIKE 'r:%'"), "taint-reach")
    while True:
        returns = known.where("target = 'return'").select(F.col("fid").alias("to"), "origin")
        brought = given.where("to IS NOT NULL").join(returns, "to").where(F.col("origin") == F.concat(F.lit("p:"), F.col("p"))).select("fid", "call", "target")
        through = brought.unionByName(given.where("to IS NULL").select("fid", "call", "target")).distinct()
        handed = known.join(through, ["fid", "target"]).select("fid", "origin", "call")
        made = bound.join(returns.where(F.col("origin") == SOURCE), "to").select("fid", "origin", "call")
        more = handed.unionByName(made).distinct().join(results, ["fid", "call"]).select("fid", "origin", "target").distinct()
        more = stored(more.join(known, ["fid", "origin", "target"], "left_anti"), "taint-more")
        if more.isEmpty():
            return known
        known = stored(known.unionByName(more), "taint-reach")


def taint_flows(files: DataFrame, depth: int | None = None) -> DataFrame:
    """files(path, code) → source_path, source_function, sink_path, sink_function, sink, line, hops, via: for each function
    that reads outside input and each dangerous call that it reaches, the fewest calls between them, and the functions on
    that way. depth bounds the number of functions on a way."""
    facts = flow_facts(files).withColumn("fid", F.concat_ws("#", "path", "function", "start"))
    target = F.when(F.col("kind") == "return", "return").when(F.col("kind").isin("sink", "arg"), F.concat_ws(":", "kind", "call", F.coalesce(F.col("arg").cast("string"), F.col("name"), F.lit("*"))))
    facts = stored(facts.withColumn("target", target), "taint-facts")
    bound = stored(bindings(facts), "taint-calls")
    # what a sink is given goes on into its result, as with unknown functions
    given = stored(_given(facts.where("kind IN ('arg', 'sink')"), bound), "taint-given")
    known = reach(facts, bound, given)
    node = F.concat(F.col("fid"), F.lit("?"), F.substring("origin", 3, 20))
    inner = given.where("to IS NOT NULL").withColumn("dst", F.concat("to", F.lit("?"), F.col("p").cast("string")))
    steps = known.join(inner, ["fid", "target"]).select(F.when(F.col("origin") == SOURCE, F.col("fid")).otherwise(node).alias("src"), "dst").distinct()
    ends = facts.where("kind = 'sink'").select("fid", "target", F.col("path").alias("sink_path"), F.col("function").alias("sink_function"), F.col("callee").alias("sink"), "line").distinct()
    ends = stored(known.join(ends, ["fid", "target"]).withColumn("node", F.when(F.col("origin") == SOURCE, F.col("fid")).otherwise(node)).drop("fid", "origin", "target").distinct(), "taint-sinks")
    starts = known.where(F.col("origin") == SOURCE).select(F.col("fid").alias("node"))
    found = taint_paths(stored(steps, "taint-steps"), starts, ends.select("node"), depth, None)
    found = found.withColumnRenamed("sink", "node").join(ends, "node")
    via = F.array_join(F.transform(F.split("path", ">"), lambda n: F.element_at(F.split(n, "#"), -2)), ">")
    path = F.expr("substring(source, 1, length(source) - length(substring_index(source, '#', -2)) - 1)")
    rows = found.select(path.alias("source_path"), F.element_at(F.split("source", "#"), -2).alias("source_function"), "sink_path", "sink_function", "sink", "line", (F.col("length") - 1).cast("long").alias("hops"), via.alias("via"))
    return rows.groupBy("source_path", "source_function", "sink_path", "sink_function", "sink", "line").agg(F.min(F.struct("hops", "via")).alias("best")).select("*", "best.hops", "best.via").drop("best")
