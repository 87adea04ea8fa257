"""Which file an import means, as equal joins with the paths of all files.

A relative module is taken from the importer's folder. Any other is known by its segments: a file answers to each end of its
own path (`src/a/b.py` to `a/b` and `b`), so absolute and package imports join on the whole module, not on a pattern. A
module of several files means the one that shares the longest path with the importer, of equals the first by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of importable files, and names that stand for their folder.
SUFFIX = r"\.(?:d\.ts|tsx?|jsx?|py|go)$"
FOLDER = r"/(?:index|__init__)$"


def _normal(path: Column) -> Column:
    """A path without `.` and `..`; one that leaves the tree keeps what is left."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _shared(a: Column, b: Column) -> Column:
    """Leading segments that two paths share."""
    pairs = F.arrays_zip(F.split(a, "/").alias("a"), F.split(b, "/").alias("b"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, p: F.struct(F.when(acc["on"] & (p["a"] == p["b"]), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & F.coalesce(p["a"] == p["b"], F.lit(False))).alias("on")))["n"]


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(path, module), files(path) → path, module, target. Modules of no file have no row; a file doesn't import
    itself. Null and empty modules are left out."""
    names = files.select(F.col("path").alias("target")).where("target IS NOT NULL").distinct()
    names = names.withColumn("name", F.regexp_replace(F.regexp_replace(F.col("target"), SUFFIX, ""), FOLDER, ""))
    asked = imports.select("path", "module").where("length(module) > 0").distinct()
    relative = asked.where(F.col("module").rlike(r"^\.{1,2}(?:/|$)"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, SUFFIX, ""), FOLDER, "")
    near = relative.withColumn("name", bare(_normal(F.concat(folder, "module")))).join(names, "name")
    # from .a.b import c: one dot is the importer's folder, each more one above it
    dots = F.length(F.regexp_extract("module", r"^\.+", 0))
    dotted = asked.where(F.col("path").endswith(".py") & F.col("module").rlike(r"^\.+[^./]"))
    above = F.concat(folder, F.repeat(F.lit("../"), dots - 1), F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/"))
    near = near.unionByName(dotted.withColumn("name", _normal(above)).join(names, "name"))
    rest = asked.where(~F.col("module").startswith("."))
    rest = rest.withColumn("name", F.when(F.col("path").endswith(".py"), F.translate("module", ".", "/")).otherwise(bare(F.regexp_replace("module", r"^[@~]/", ""))))
    parts = F.split("name", "/")
    ends = names.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("name"))
    found = near.unionByName(rest.join(ends, "name")).where("target != path")
    by = Window.partitionBy("path", "module").orderBy(F.desc(_shared(F.col("path"), F.col("target"))), "target")
    return found.withColumn("k", F.row_number().over(by)).where("k = 1").select("path", "module", "target")
