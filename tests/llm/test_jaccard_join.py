import random
import re
from pathlib import Path

import pytest

from gridcast.llm import jaccard_join
from gridcast.session import shared_dir


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    first = {}
    for i, (d, _) in enumerate(rows):  # rows of one id are one document
        if d is not None and sets[i]:
            x, y = sorted((root(first.setdefault(d, i)), root(i)))
            parent[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    name = lambda i, d: least[root(first.get(d, i))]
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else name(i, d)) for i, (d, _) in enumerate(rows))


def corpus(seed, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 5])))
    passage = [word() for _ in range(40)]
    texts = [None, "", "  \n\t", "One two", "one TWO", "one two three", "É é", "a\x0bb\x0cc\xa0d\x1ce f g"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or len(texts) < 20:
            words = [word() for _ in range(rng.choice([3, 8, 30, 120]))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words)) : 0] = passage
        else:
            words = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    big = [word() for _ in range(80)]
    for _ in range(90):  # a large group of near copies
        words = list(big)
        words[rng.randrange(80)] = word()
        if rng.random() < 0.3:
            words[rng.randrange(80)] = word()
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    for size in (7, 12, 18, 25):  # sets that are mostly one passage and differ in the rest
        texts += [" ".join(passage + [word() + str(rng.randrange(10**6)) for _ in range(rng.randrange(size))]) for _ in range(12)]
    ids = rng.sample(range(10_000), len(texts))
    ids[12] = None
    for _ in range(8):  # one id with several texts, an empty one among them
        ids[rng.randrange(20, len(ids))] = ids[rng.randrange(20, len(ids))]
    ids[30] = ids[1]
    return list(zip(ids, texts))


@pytest.mark.parametrize(("seed", "heavy", "block"), [(1, 50, 4096), (2, 3, 16)])
def test_against_brute_force(spark, seed, heavy, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    got = jaccard_join.near_documents(docs).toPandas()
    got = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_shingles, -1 if r.component_id != r.component_id else int(r.component_id)) for r in got.itertuples())
    assert got == brute(rows)


def test_keep_one_and_empty(spark):
    text = "one two three four five six seven"
    rows = [(4, text, "a"), (2, text, "b"), (9, "other", "c"), (9, "other", "c"), (None, text, "d"), (5, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(r["source"] for r in jaccard_join.keep_one(docs).collect())
    assert kept == ["b", "c", "c", "d", "e"]
    assert jaccard_join.near_documents(docs.limit(0)).count() == 0


def test_chains_inside_one_group(spark):
    rng = random.Random(7)
    rows = []
    for k in range(70):  # clusters that share no word, each a chain of texts that differ by a shingle a step
        words = [f"c{k}w{rng.randrange(10**6)}" for _ in range(19)]
        rows += [(rng.randrange(10**9), " ".join(words[s : s + 16])) for s in range(3 + k % 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_documents(docs).collect())
    assert got == brute(rows)
    assert jaccard_join.keep_one(docs).count() == 70


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, long[:400_000]), (4, "w1 w2 w3 w4 w5")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_tables_in_between_are_deleted(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "gridcast"
    tables = lambda: {p.name for p in folder.glob("*") if not p.name.startswith(".")}
    before = tables()
    assert jaccard_join.near_documents(spark.createDataFrame(corpus(3, 20), "doc_id long, text string")).count() > 0
    assert [name.partition("-")[0] for name in tables() - before] == ["classes"]
