import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from gridcast.llm import quality


def corpus(n=600):
    rng = random.Random(4)
    syllables = ["ta", "lo", "mi", "ren", "sta", "ou", "el", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3])))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([20, 60, 200]))]
        good = rng.random() < 0.8
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * 200, [w + " |" for w in words]])
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_fold(spark):
    rows, marks = corpus()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    test = [(i, q) for i, q, _ in marks if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == q for i, q in test) / len(test) > 0.95
    # labels of the held-out fold play no part
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, other)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def brute(model, text):
    """The score by compressing block after block with a compressor made anew for each."""
    data, size = (text or "").encode(), {}
    if not data:
        return 0.5
    for k in ("good", "bad"):
        own = zstandard.ZstdCompressionDict(getattr(model, k))
        size[k] = 0
        for at in range(0, len(data), 2048):
            c = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[k] += len(c.compress(data[at : at + 2048]))
    x = (size["bad"] - size["good"]) / (len(data) + 10)
    return 1 / (1 + math.exp(-max(-30, min(30, x * model.curve[0] + model.curve[1]))))


def test_scores_against_brute_force(spark):
    rows, marks = corpus(300)
    rows += [(1000, None), (1001, ""), (1002, "é" * 50_000), (1003, " ".join(t for _, t in rows) * 3)]
    marks.append((1003, 1, 0))  # a long text is fitted by blocks across it
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model.good and model.curve[0] > 0
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(brute(model, t), abs=1e-12)
    cut = {r["id"]: bytes(r["t"]) for r in docs.select(F.col("doc_id").alias("id"), quality._sampled(F.col("text").cast("binary"), 20_000).alias("t")).collect() if r["t"]}
    long = rows[-1][1].encode()
    assert cut[1003] == b"".join(long[(len(long) - 2048) * i // 8 :][:2048] for i in range(9)) and cut[0] == rows[0][1].encode()


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 7, 0)]])
def test_odd_rows_and_few_labels(spark, marks):
    rows = [(1, None, "a"), (None, "", "b"), (2, "x" * 300_000, "c"), (2, "x" * 300_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = quality.score(docs, model).toPandas()
    assert len(got) == 4 and got.score.between(0, 1).all() and got.held_out.notna().all()
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert quality.score(docs.limit(0), model).count() == 0
