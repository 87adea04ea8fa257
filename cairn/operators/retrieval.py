"""Search: lexical (BM25), vectors, rank fusion, penalties and checks. Query terms and vectors are bounded inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import stored

#: Words that overlap scores leave out.
STOP_WORDS = ("the", "and", "for", "all", "add", "with", "that", "this", "from", "are", "was", "to", "in", "of")


def terms(query: str) -> list[str]:
    """Distinct lower-cased words of ASCII letters, digits and underscores; no stemming."""
    return sorted({w for w in re.split(r"[^a-z0-9_]+", query.lower()) if w})


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, k: int = 20) -> DataFrame:
    """docs(doc_id, text) → the k best by BM25. Texts are split once: their lengths and query terms are kept as a narrow
    table, which all counts come from."""
    words = docs.where("text is not null").select("doc_id", F.split(F.lower("text"), "[^a-z0-9_]+").alias("w"))
    # only the first and the last part of a split can be empty
    ends = F.when(F.col("w")[0] == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    rows = stored(words.select("doc_id", (F.size("w") - ends).alias("len"), F.filter("w", lambda x: x.isin(terms(query))).alias("terms")), "bm25")
    size = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    hits = rows.select("doc_id", "len", F.explode("terms").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(size), F.lit(True)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; of normalised vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vectors(id, embedding, ...) with score, for one query vector."""
    return vectors.withColumn("score", F.round(dot(F.col("embedding"), F.array(*map(F.lit, query))), 6))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    return cosine(vectors, query).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def rrf_fusion(ranked_a: DataFrame, ranked_b: DataFrame, k: int = 60, w: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Two rankings (id, rank from 1) → id, score: weighted reciprocal ranks, summed."""
    part = lambda d, x: d.select("id", (x / (k + F.col("rank"))).alias("s"))
    return part(ranked_a, w[0]).unionByName(part(ranked_b, w[1])).groupBy("id").agg(F.round(F.sum("s"), 8).alias("score"))


def ranked(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """id and rank of the first k rows: limited before it is numbered, so only k rows meet in one task."""
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank")


def semantic_penalty(scored: DataFrame) -> DataFrame:
    """scored(id, score, is_test, is_container) → score halved for tests and for data containers."""
    half = lambda c: F.when(F.col(c), 0.5).otherwise(1.0)
    return scored.select("id", F.round(F.col("score") * half("is_test") * half("is_container"), 8).alias("score"))


def structural_seed(scored: DataFrame, files: list[str], bonus: float = 0.5, k: int = 30) -> DataFrame:
    """scored(id, file, score) → score raised for rows of the named files; the k best."""
    up = F.when(F.col("file").isin(files), bonus).otherwise(0.0)
    return scored.select("id", F.round(F.coalesce("score", F.lit(0.0)) + up, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def grounding(claimed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The claimed keys that exist."""
    return claimed.join(known.select(key), key, "left_semi")


def word_overlap(docs: DataFrame, task: str, gate: float = 0.15) -> DataFrame:
    """docs(id, text) → share of the task's words, without stop words, that the text has; above the gate."""
    words = sorted({w for w in re.split(r"[\s_]+", task.lower()) if w} - set(STOP_WORDS))
    own = F.filter(F.array_distinct(F.split(F.lower(F.col("text")), r"[\s_]+")), lambda x: (x != "") & ~x.isin(list(STOP_WORDS)))
    n = F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    return docs.select("id", F.round(n / F.lit(max(1, len(words))), 6).alias("score")).where(F.col("score") > gate)


def recall_at_k(best: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """best(item, rank: of its best hit, null if none) → k, recall."""
    rows = best.agg(*[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"k{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in ks]))
    return rows.select(pairs.alias("r")).select("r.k", "r.recall")


def project_map(symbols: DataFrame, per_file: int = 10) -> DataFrame:
    """symbols(file, name) → file, names: its first names in order."""
    by = Window.partitionBy("file").orderBy("name")
    rows = symbols.distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_file)
    return rows.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


def within_budget(rows: DataFrame, budget: int, always: int = 2) -> DataFrame:
    """rows(group, id, score, tokens) → what a greedy reader keeps: the first `always`, then each that still fits.

    The rows of a group come sorted and are folded as a stream."""

    def run(batches):
        import pyarrow as pa

        group, spent, taken, begun = None, 0, 0, False
        for b in batches:
            keep = []
            for g, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or g != group:
                    group, spent, taken, begun = g, 0, 0, True
                ok = taken < always or spent + n <= budget
                spent, taken = spent + n * ok, taken + ok
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    cols = rows.select("group", "id", "score", "tokens")
    return cols.repartition("group").sortWithinPartitions("group", F.desc("score"), "id").mapInArrow(run, cols.schema)
