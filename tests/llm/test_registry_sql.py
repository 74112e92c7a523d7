"""op3 and op10 beside their SQL on tables with links, chains, repeated ids and odd rows."""

import random

import duckdb
import numpy as np
import pandas as pd

from gridcast.llm import registry


def _same(spark, folder, table, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(-1 if pd.isna(v) else int(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
    return want


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 32))
    vecs = [(base[k % 30] + rng.standard_normal(32) * 0.1).astype("float32").tolist() for k in range(240)] + rng.standard_normal((60, 32)).astype("float32").tolist()
    vecs += [vecs[0], None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] + [1.0] * 31]
    ids = rng.permutation(len(vecs)).tolist()
    spark.createDataFrame(list(zip(ids, vecs)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/table")
    next((tmp_path / "table").glob("part-*.parquet")).rename(tmp_path / "embeddings.parquet")
    want = _same(spark, tmp_path, "embeddings", "op3_embeddings")
    assert want["n_links"].sum() > 1000


def test_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in range(25):
        words = [f"W{c}x{k}" for k in range(rng.choice([3, 12, 40, 120]))]
        for step in range(rng.randrange(1, 7)):  # a chain: each differs from the one before by a word or two
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"n{c}s{step}"
            words = words if rng.random() < 0.5 else [*words, "Tail"]
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "\t\n ", "One", "one", "a b\tc", "A B C", "same words " * 50, "same words " * 40])]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/table")
    next((tmp_path / "table").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    want = _same(spark, tmp_path, "documents", "op10_jaccard_join")
    assert (want["component_id"] != want["doc_id"]).sum() > 10
