"""Reachability over edges(src, dst), as joins of a frontier with the edges: until the frontier is empty, or for `depth`
rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int | None = None, cap: int | None = 15) -> DataFrame:
    """sources(node), sinks(node) → source, sink, length (nodes), path: for each pair the shortest path, of equals the
    first by text; the first `cap` by source, length and path, or all. A source that is a sink is a path of one node. Each round's
    frontier is stored, so that plans stay short, and the search ends with the first empty one; depth bounds it earlier."""
    edges = edges.select("src", "dst").distinct()
    first = sources.select("node").distinct().select(F.col("node").alias("source"), "node", F.lit(1).alias("length"), F.col("node").cast("string").alias("path"))
    seen = frontier = first
    k = 1
    while depth is None or k < depth:
        k += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node"), F.lit(k).alias("length"), F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path"))
        step = step.groupBy("source", "node", "length").agg(F.min("path").alias("path"))
        frontier = stored(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", "length", "path"), "taint")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    hit = seen.join(sinks.select("node").distinct(), "node").select("source", F.col("node").alias("sink"), "length", "path")
    return hit if cap is None else hit.orderBy("source", "length", "path").limit(cap)


def blast_radius(calls: DataFrame, vulnerable: DataFrame, exposed: DataFrame) -> DataFrame:
    """calls(symbol, caller), vulnerable(symbol), exposed(caller) → symbol, n_callers, n_exposed."""
    rows = calls.join(vulnerable.distinct(), "symbol").select("symbol", "caller").distinct().join(exposed.distinct().withColumn("open", F.lit(1)), "caller", "left")
    return rows.groupBy("symbol").agg(F.count("*").alias("n_callers"), F.count("open").alias("n_exposed"))


def downstream(edges: DataFrame, roots: DataFrame, k: int = 30) -> DataFrame:
    """roots(node) → root, node: what each calls, other than itself; k rows."""
    rows = edges.join(roots.select(F.col("node").alias("src")).distinct(), "src").where("src != dst").select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct()
    return rows.orderBy("root", "node").limit(k)


def traverse(edges: DataFrame, roots: DataFrame, depth: int = 3, eager: int = 5) -> DataFrame:
    """roots(node) → root, node, depth: breadth first, following at most `eager` callees of a node, each node once."""
    by = Window.partitionBy("src").orderBy("dst")
    kept = edges.select("src", "dst").distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= eager).select("src", "dst")
    seen = frontier = roots.select("node").distinct().select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = frontier.join(kept, frontier["node"] == kept["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen
