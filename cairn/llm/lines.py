"""Cross-site line deduplication by distinct-site spread, with DataFrame functions only.

A line's sites are the distinct non-null `source` values of the documents that hold it. HyperLogLog sketches of them are
built for each line hash and merged by the aggregation, before and after the shuffle. Lines whose estimate is clearly at
or above `min_sites` are boilerplate; those near it, within `band` of it on either side, are counted exactly; the rest
is not boilerplate. A boilerplate line is removed from every document but the one with the smallest doc_id that holds it.

Lines are what lies between newlines, compared exactly; lines of spaces alone are kept and not counted as boilerplate.
A line is known by 128 bits of hash. A line that many documents hold is aggregated before it is shuffled, and the join
that finds its documents is salted, so a hot line is dealt over many tasks.

Defined cases: a null text stays null, with no lines; an empty one has one empty line; rows with a null source add no
site; rows with a null doc_id are never the first holder; equal rows are treated alike; all columns of the input are
returned, those the operator adds replace none: its inner columns carry a prefix that is made unlike the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import shared

MIN_SITES = 10
#: Registers of a sketch: 2 ** LG_K; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
SALTS = 16


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, source, place and hash of every line that isn't blank."""
    cut = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where(F.length(F.trim("line")) > 0).select("doc_id", "th", "source", "pos", _hashes(F.col("line")).alias("h")).select("doc_id", "th", "source", "pos", "h.a", "h.b")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes (a, b) of the boilerplate lines and their first holder, stored.

    The lines whose estimate isn't clearly too low are few; they are stored, and only lines near the threshold take part
    in the exact count: the others leave before it is shuffled.
    """
    band = max(2.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    lines = _lines(docs)
    sketch = F.hll_sketch_agg(F.col("source").cast("string"), F.lit(lg_k))
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(sketch).alias("sites"), F.min("doc_id").alias("first")).where(F.col("sites") >= min_sites - band)
    spread = shared.stored(spread, "lines-spread")
    clear = spread.where(F.col("sites") > min_sites + band).select("a", "b", "first")
    near = spread.where(F.col("sites") <= min_sites + band).select("a", "b", "first")
    pairs = lines.where("source is not null").select("a", "b", "source").join(near, ["a", "b"], "left_semi").distinct()
    exact = pairs.groupBy("a", "b").agg(F.count("source").alias("sites")).where(F.col("sites") >= min_sites).join(near, ["a", "b"]).select("a", "b", "first")
    return shared.stored(clear.unionByName(exact), "lines-found")


def removals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """For each (doc_id, text hash), the places of the lines that it loses, rising."""
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = _lines(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    lost = held.join(salted, ["a", "b", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def _without(split: Column, lost: Column) -> Column:
    """An array without the elements at rising places: what lies between them, in time proportional to both."""
    edge = F.concat(F.array(F.lit(-1)), lost, F.array(F.size(split)))
    between = F.transform(F.sequence(F.lit(0), F.size(lost)), lambda k: F.slice(split, F.get(edge, k) + 2, F.get(edge, k + 1) - F.get(edge, k) - 1))
    return F.flatten(between)


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines removed from text; with counts also n_lines and n_removed beside it.

    Of an input column named n_lines or n_removed, the operator's own takes the place if it counts.
    """
    core = docs.select("doc_id", "text", "source")
    lost = removals(core, boilerplate(core, min_sites, lg_k))
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    lost = lost.select(F.col("doc_id").alias(f"{mark}id"), F.col("th").alias(f"{mark}th"), F.col("lost").alias(f"{mark}lost")).hint("shuffle_hash")
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost[f"{mark}id"]) & F.xxhash64(docs["text"]).eqNullSafe(lost[f"{mark}th"]), "left")
    split = F.split("text", "\n")
    less = F.array_join(_without(split, F.col(f"{mark}lost")), "\n")
    text = F.when(F.col(f"{mark}lost").isNull(), F.col("text")).otherwise(less)
    own = {"n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"), "n_removed": F.coalesce(F.size(f"{mark}lost"), F.lit(0)).cast("long")} if counts else {}
    columns = [text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns if c.lower() not in own]
    return joined.select(*columns, *(v.alias(k) for k, v in own.items()))
