import zlib

import pytest

from gridcast.llm.sharding import shard_by_bytes


@pytest.mark.parametrize("parts", [1, 5])
def test_contiguous_equal_cuts(spark, parts):
    texts = [None, "", "é" * 40, "a", "a", "b" * 500] + [f"text {i % 7} " * (i % 13) for i in range(400)]
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)] + [(9, "same", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(parts)
    got = shard_by_bytes(docs, 8).toPandas()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), size(r[1]))
    want = sorted(rows, key=key)
    got = got.sort_values(["shard", "slot"])
    total, at = sum(size(r[1]) for r in rows), 0
    for r, (_, g) in zip(want, got.iterrows(), strict=True):
        assert g["size"] == size(r[1]) and g.text_crc32 == zlib.crc32((r[1] or "").encode())
        assert g.shard == min(7, (2 * at + size(r[1])) * 8 // (2 * total))
        at += size(r[1])
    for _, own in got.groupby("shard"):
        assert own.slot.tolist() == list(range(len(own)))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_empty_and_equal_rows(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = shard_by_bytes(spark.createDataFrame([(1, "x")] * 80, "doc_id long, text string")).toPandas()
    assert got.groupby("shard").size().tolist() == [10] * 8
