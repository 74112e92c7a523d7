"""Training-corpus pipeline: five filters and transforms of documents, each written as Parquet and read again.

1. quality: documents that the compression classifier scores below 0.7 go, null and empty ones (0.5) among them.
2. line_dedup: boilerplate lines on at least five sites go, but for their first occurrence; so do documents of which
   nothing is left.
3. near_dedup: of documents linked by similarity of word shingles, the one of the smallest id stays.
4. decontaminate: documents that hold a window of a benchmark item go.
5. packing: what is left is tokenised and packed into sequences.

Cases: null ids pass every stage but link with nothing; rows of one id are one document for near_dedup, and go or stay
together; a null source adds no site; equal rows are one group, of which near_dedup keeps all rows of the smallest id;
columns beyond those of documents are carried, whatever their names, up to packing; an empty table, or no labels, gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from gridcast.llm.common import write_table
from gridcast.llm.registry import tokenizer_path

#: No SQL expresses the classifier or the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, threshold=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(docs, min_sites=5)
    cleaned = cleaned.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, shingle=5, percent=75)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
