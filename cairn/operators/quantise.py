"""Close vectors by a coarse quantiser: each vector lies in the cell of its nearest centre, and a query meets cells only.

Centres are a bounded sample of the vectors (those with the least hashes), so what tasks get of them has a bound. A query is
sent to cells and meets their vectors there; all of these pairs are verified on whole vectors. By the triangle inequality of
angles, a cell whose vectors lie between two angles from its centre can be ruled out for a query: the search is exact, and
as costly as the data let it be (queries unlike all centres meet every cell). With `probes` a query meets the nearest of those
cells only, and may lose links. Cells that hold many rows or queries are dealt into lots, so no task holds a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairn.session import stored

#: Angles come from single-precision vectors of length about one.
SLACK = 1e-3
#: Rows of either side that meet in a task at a time: a cell with more is dealt into lots, each pair of them a group.
LOT = 2048


def centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """At most `cells` different vectors of length one, those with the least hash of their id."""
    live = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(cells)
    found = [v / n for r in live.select("embedding").collect() if (n := np.linalg.norm(v := np.asarray(r[0], float))) > 0]
    return np.unique(np.array(found), axis=0) if found else np.empty((0, 0))


def _angles(column: pd.Series, middle: np.ndarray) -> np.ndarray:
    block = np.array(column.tolist(), float).reshape(len(column), -1)
    size = np.linalg.norm(block, axis=1, keepdims=True)
    return np.arccos(np.clip(block / np.where(size > 0, size, 1) @ middle.T, -1, 1))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def in_cells(vectors: DataFrame, middle: np.ndarray) -> DataFrame:
    """vectors(id, embedding) → id, embedding, cell, angle to its centre, the nearest one (of equals the first)."""

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            angles = _angles(part, middle)
            cell = angles.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype("int32"), "angle": angles[np.arange(len(part)), cell]})

    return vectors.where("embedding IS NOT NULL").select("id", "embedding", nearest("embedding").alias("at")).select("id", "embedding", "at.cell", "at.angle")


def semantic_links(chunks: DataFrame, vectors: DataFrame, gate: float = 0.72, cells: int = 64, probes: int | None = None) -> DataFrame:
    """chunks(chunk, c) and vectors(id, embedding), vectors of length one → chunk, id, confidence (0.85 of the cosine, from
    0.55 to 0.75) of the pairs whose cosine, rounded to six places, is at least `gate`.

    Without probes every such pair; with probes those of each query's nearest cells. Null vectors have no links; without
    vectors there are none. Ids may repeat: each row is a vector of its own."""
    middle = centres(vectors, cells)
    wide = math.acos(max(-1.0, min(1.0, gate - 1e-6))) + SLACK
    if not len(middle):
        return vectors.join(chunks.limit(0), F.lit(False)).select("chunk", "id", F.lit(0.0).alias("confidence"))
    own = F.monotonically_increasing_id().alias("n")  # deals rows out, also where ids repeat
    placed = stored(in_cells(vectors, middle).select("*", own), "cells")
    spans = placed.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()  # a row for each centre at most
    at = np.array([s[0] for s in spans], int)
    low, high = (np.array([s[k] for s in spans], float) for k in (1, 2))

    @F.pandas_udf("array<int>")
    def met(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for turn in _angles(part, middle[at]):
                hit = np.flatnonzero((turn <= high + wide) & (turn >= low - wide))
                out.append(at[hit[np.argsort(turn[hit], kind="stable")][:probes]].astype("int32"))
            yield pd.Series(out)

    asked = stored(chunks.where("c IS NOT NULL").select("chunk", "c", met("c").alias("cells"), own), "asked")
    asked = asked.select("chunk", "c", "n", F.explode("cells").alias("cell"))
    lots = {"vlot": dict.fromkeys(range(len(middle)), 1), "qlot": dict.fromkeys(range(len(middle)), 1)}
    lots["vlot"] |= {s[0]: -(-s[3] // LOT) for s in spans}
    lots["qlot"] |= {s[0]: -(-s[1] // LOT) for s in asked.groupBy("cell").count().collect()}
    count = {k: F.array(*(F.lit(v[c]) for c in range(len(middle))))[F.col("cell")] for k, v in lots.items()}

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in a lot of its own side, once for each lot of the other."""
        return rows.withColumn(mine, F.pmod("n", count[mine])).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), count[other].cast("long") - 1)))

    keys = ["cell", "vlot", "qlot"]
    v = dealt(placed.select("id", "embedding", "cell", "n"), "vlot", "qlot").groupBy(*keys)
    q = dealt(asked, "qlot", "vlot").groupBy(*keys)
    spec = StructType([StructField("chunk", chunks.schema["chunk"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("cos", DoubleType())])

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        hit_v = hit_q = np.empty(0, int)
        cos = np.empty(0)
        if len(left) and len(right):
            a, b = _matrix(left["embedding"]), _matrix(right["c"])
            cos = a @ b.T
            hit_v, hit_q = np.nonzero(cos >= gate - 1e-6)
            cos = cos[hit_v, hit_q]
        return pa.table({"chunk": right["chunk"].take(pa.array(hit_q)), "id": left["id"].take(pa.array(hit_v)), "cos": cos})

    pairs = v.cogroup(q).applyInArrow(close, spec).withColumn("cos", F.round("cos", 6)).where(F.col("cos") >= gate)
    return pairs.select("chunk", "id", F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.75), 0.85 * F.col("cos"))), 5).alias("confidence"))
