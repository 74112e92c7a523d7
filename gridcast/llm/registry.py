"""Queries opN_<name> over the whole test tables, with the SQL that expresses them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, html_text, jaccard_join, line_dedup, packing, pii, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(_table(spark, sf_dir, "documents"), min_sites=5)
    n_chars = F.length("text").cast("long").alias("n_chars")
    return cleaned.select("row.doc_id", "n_lines", "n_removed", n_chars, F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "h1", "h2")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_embeddings": op3_embeddings,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_html_text": op8_html_text,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES = {
    "op3_embeddings": embeddings.SQL,
    "op5_chat": chat.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
}
