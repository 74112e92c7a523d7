import corpus_pipeline
from gridcast.llm import quality

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as near
from .test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, text = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "quality":
            source = spark.createDataFrame(before, docs.schema)
            model = quality.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(kept[name]) == {r["doc_id"] for r in quality.score(source, model).collect() if r["predicted"]}
        elif name == "line_dedup":
            want = [eval(x) for x in lines([(r["doc_id"], r["text"], r["source"]) for r in before], 5)]
            want = {int(d): t for d, _, t, _, gone in want if not gone or t.strip(" ")}
            assert {d: r["text"] for d, r in kept[name].items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
        elif name == "near_dedup":
            assert set(kept[name]) == {d for d, _, c in near(rows) if d == c}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept[name]) == {r[0] for r in contaminated(rows, items) if not r[-1]}
        else:
            got = docs.toPandas()
            assert set(got.doc_id) == {d for d, _ in rows}
            assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and "sequence_id" in got.columns


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    text = max((r["text"] for r in good.collect() if r["text"]), key=len)
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", None, 0), (None, text, None, "s", 1), (9003, text, "en", "s", 1), (9003, text, "en", "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "7 AS score", "8 AS node", "9 AS h1")
    for name, frame in (("documents", rows), ("labels", spark.read.parquet(f"{SF}/labels.parquet")), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        frame.write.parquet(f"{tmp_path}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/full").select("doc_id").collect()}
    assert None in got and not got & {9001, 9002} and len(got) > 50
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
