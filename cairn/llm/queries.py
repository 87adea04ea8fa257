"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, fim, html, lexical, lines, lm, neardup, quality, rankbpe, shared, sql, substrings, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def substring_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(substrings.removed(table(spark, sf_dir, "documents")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), percent=80, width=2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared.folder(spark)}/warc-{uuid.uuid4().hex}"
    found = warc.read_back(warc.archive(table(spark, sf_dir, "pages"), folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), bpe_path()))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").withColumn("held_out", lm.held_out()), "held_out")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return rankbpe.digests(rankbpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_lm": op2_lm, "op3_toxicity": op3_toxicity, "op4_substrings": op4_substrings, "op5_near_dup": op5_near_dup, "op6_warc": op6_warc, "op7_line_spread": op7_line_spread, "op8_main_text": op8_main_text, "op9_quality": op9_quality, "op10_bpe": op10_bpe, "op11_fim": op11_fim, "op12_lexical": op12_lexical, "op13_rank_bpe": op13_rank_bpe, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
