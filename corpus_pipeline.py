"""From documents to token ids: toxic documents go, then boilerplate lines, near copies and benchmark items; the rest is
encoded. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, lines, neardup, shared, toxicity
from cairn.llm.queries import bpe_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text."""
    clean = lines.dedup(docs, counts=False)
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return clean.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32) and the digest of the text they decode to."""
    coded = bpe.encode_decode(docs, bpe_path())
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The trained toxicity model and the merges can't be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written as Parquet and reread, and a stage's own tables are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with shared.scratch(spark):
            docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}", scratch=False)
    return docs
