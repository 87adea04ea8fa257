"""Which texts contain which needles, as an equal join on the needle's rarest gram.

A text can only contain a needle if it contains each of its grams (runs of GRAM characters; a shorter needle is its own).
The grams that any needle has are looked for in the texts and counted; each needle is known by the one that the fewest texts
hold, and only those are compared with it. So there is no nested loop of needles and texts: a needle meets as many texts as
hold its rarest gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored

GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; one pass over the text's characters."""
    chars = F.split(text, "")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(text) - n), lambda i: F.array_join(F.slice(chars, i + 1, n), "")))


def contains_join(texts: DataFrame, needles: DataFrame, fold: bool = False, gram: int = GRAM) -> DataFrame:
    """texts(text), needles(needle) → text, needle: each different pair where the text contains the needle, with fold
    whatever the case. Null and empty needles are in no text here; texts without a needle's grams are never compared."""
    shape = F.lower if fold else (lambda c: c)
    t = texts.select("text").where("text IS NOT NULL").distinct().withColumn("t", shape(F.col("text")))
    n = needles.select("needle").where("length(needle) > 0").distinct().withColumn("n", shape(F.col("needle"))).withColumn("size", F.least(F.length("n"), F.lit(gram)))
    wanted = None
    found = None
    for size in range(1, gram + 1):
        own = n.where(F.col("size") == size).select("needle", "n", F.explode(_grams(F.col("n"), size)).alias("gram"))
        wanted = own if wanted is None else wanted.unionByName(own)
        held = t.where(F.length("t") >= size).select("text", "t", F.explode(_grams(F.col("t"), size)).alias("gram"))
        held = held.join(own.select("gram").distinct(), "gram", "left_semi")
        found = held if found is None else found.unionByName(held)
    found = stored(found, "contain")
    count = found.groupBy("gram").agg(F.count("*").alias("texts"))
    # a needle with a gram that no text holds is in none
    rarest = wanted.join(count, "gram", "left").withColumn("k", F.row_number().over(Window.partitionBy("needle").orderBy(F.asc_nulls_first("texts"), "gram"))).where("k = 1 AND texts IS NOT NULL")
    return found.join(rarest.select("needle", "n", "gram"), "gram").where(F.col("t").contains(F.col("n"))).select("text", "needle").distinct()
