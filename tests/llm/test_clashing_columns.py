"""Extra columns whose names operators use themselves change nothing, and survive where rows are carried."""

import pytest
from pyspark.sql import functions as F

from gridcast.llm import chat, decontaminate, embeddings, html_text, jaccard_join, line_dedup, packing, pii, quality, sharding
from gridcast.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
CLASH = ["id", "row", "h", "h1", "h2", "n", "node", "grp", "text_crc32", "part", "size", "shard", "slot", "score", "words", "pos", "spans", "lines", "drop", "d1", "gone_id", "component_id", "ids", "start", "kind", "low", "path", "k1", "gid", "vec", "c", "at", "chunk", "a.b"]


def wide(df):
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH if c not in df.columns))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(120) for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations")}


def test_results_are_the_same(tables):
    docs, bench = tables["documents"], tables["benchmark"]
    model = quality.fit(docs, wide(tables["labels"]))
    runs = [
        lambda d: pii.digest(pii.find(d)),
        sharding.shard_by_bytes,
        lambda d: quality.score(d, model),
        lambda d: line_dedup.clean(d, 3).drop("row"),
        lambda d: decontaminate.scan(d, wide(bench)),
        lambda d: packing.pack(d, tokenizer_path()).drop("sequence_id", "offset", "ids_crc32", "ids", "start", "length"),
        jaccard_join.near_documents,
    ]
    for run in runs:
        assert same(run(docs), run(wide(docs)))
    assert same(embeddings.near_vectors(tables["embeddings"]), embeddings.near_vectors(wide(tables["embeddings"])))
    assert same(html_text.extract(tables["pages"]), html_text.extract(wide(tables["pages"])))
    assert same(chat.format_chats(tables["conversations"]), chat.format_chats(wide(tables["conversations"])))


def test_carried_rows_keep_all_columns(tables):
    docs = wide(tables["documents"])
    model = quality.fit(tables["documents"], tables["labels"])
    for kept in (quality.keep_good(docs, model), decontaminate.drop_contaminated(docs, tables["benchmark"]), jaccard_join.keep_one(docs)):
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count() and kept.filter("slot <> 7").count() == 0
    assert line_dedup.clean(docs, 3).select("row.*").columns == docs.columns
