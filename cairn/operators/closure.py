"""What a set of definitions needs from its own file, in rounds that double the length of the paths known.

Pairs of names that reach each other are contracted to the lesser one as soon as both directions are known, so a group that is
densely tied is one name after its first rounds. What is held is at most the square of the names of a file with a start: files
don't meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import discard, kept

# Names that are never dependencies.
IGNORED = ("__name__", "__file__", "__doc__", "self", "cls", "None", "True", "False", "args", "kwargs", "Exception", "RuntimeError", "NotImplementedError")


def reach(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """edges(path, src, dst) → pairs(path, src, dst) of heads of which one reaches the other by any number of edges;
    heads(path, name, head) of the names that stand for another (names not in it are their own head); and the folders of both, for
    the caller to discard. All names of a cycle have one head."""
    spark = edges.sparkSession
    pairs, at = kept(edges.where("src != dst").select("path", "src", "dst").distinct(), "closure")
    heads, heads_at = kept(pairs.select("path", F.col("src").alias("name"), F.col("dst").alias("head")).limit(0), "heads")
    size = pairs.count()
    while True:
        onward = pairs.select("path", F.col("src").alias("dst"), F.col("dst").alias("end"))
        longer = pairs.join(onward, ["path", "dst"]).where("src != end").select("path", "src", F.col("end").alias("dst"))
        grown, grown_at = kept(pairs.unionByName(longer).distinct(), "closure")
        back = grown.select("path", F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = grown.join(back, ["path", "src", "dst"], "left_semi").where("dst < src").groupBy("path", F.col("src").alias("label")).agg(F.min("dst").alias("to"))
        merged, merged_at = kept(mutual, "merged")
        discard(spark, at)
        if merged.isEmpty():
            discard(spark, merged_at)
            pairs, at, before, size = grown, grown_at, size, grown.count()
            if size == before:
                return pairs, heads, [at, heads_at]
            continue
        # a label stands for the names that took it, and for the name itself unless that has another label
        for side in ("src", "dst"):
            to = merged.withColumnRenamed("label", side)
            grown = grown.join(to, ["path", side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
        pairs, at = kept(grown.where("src != dst").select("path", "src", "dst").distinct(), "closure")
        moved = heads.join(merged.withColumnRenamed("label", "head"), ["path", "head"], "left").select("path", "name", F.coalesce("to", "head").alias("head"))
        fresh = merged.withColumnRenamed("label", "name").join(heads, ["path", "name"], "left_anti").select("path", "name", F.col("to").alias("head"))
        old = heads_at
        heads, heads_at = kept(moved.unionByName(fresh), "heads")
        discard(spark, old, grown_at, merged_at)
        size = pairs.count()


def dependency_closure(uses: DataFrame, initial: DataFrame) -> DataFrame:
    """uses(path, name, used: null or a name that the definition reads), initial(path, name) → path, name: the initial
    names, defined or not, and all of their file's definitions that they need, directly or through others.

    Null paths and names are left out; rows may repeat; a name of no definition leads nowhere."""
    start = initial.select("path", "name").where("path IS NOT NULL AND name IS NOT NULL").distinct()
    own = uses.select("path", "name", "used").where("name IS NOT NULL").join(start.select("path").distinct(), "path", "left_semi")
    names = own.select("path", "name").distinct()
    edges = own.where(F.col("used").isNotNull() & ~F.col("used").isin(*IGNORED)).join(names.withColumnRenamed("name", "used"), ["path", "used"], "left_semi")
    pairs, heads, at = reach(edges.select("path", F.col("name").alias("src"), F.col("used").alias("dst")))
    names = names.join(heads, ["path", "name"], "left").select("path", "name", F.coalesce("head", "name").alias("head"))
    first = names.join(start, ["path", "name"], "left_semi").select("path", "head").distinct()
    led = pairs.join(first.withColumnRenamed("head", "src"), ["path", "src"], "left_semi").select("path", F.col("dst").alias("head"))
    found = names.join(first.unionByName(led).distinct(), ["path", "head"], "left_semi").select("path", "name")
    out = kept(found.unionByName(start).distinct(), "needed")[0]
    discard(uses.sparkSession, *at)
    return out
