import hashlib
import random
import re

import pytest

from gridcast.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                grams.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if (g := grams.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= g
        out.append((-1 if d is None else d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("short", [True, False])
def test_against_brute_force(spark, limit, short):
    rng = random.Random(2)
    word = lambda: rng.choice(["The", "of", "é", "x1", "日本", "zeta"]) + rng.choice(["", "a", "Bc", "9"])
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 15, 30])))) for i in range(12)] + [(3, "repeated id " * 6), (20, None), (None, "no id at all " * 5)]
    items += [(30, "Tiny item"), (31, "one"), (32, "..."), (33, "Tiny ITEM")] if short else []
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    for i in range(60, 140):
        w = (rng.choice(items)[1] or "").split()
        a = [word() for _ in range(20)]
        rows.append((i, ", ".join(a + w[rng.randrange(3) : len(w) - rng.randrange(3)] + a[:5] + w)))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, "tiny-item! tiny item one"), (503, items[0][1]), (503, items[0][1]), (504, "x " * 30_000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, max_broadcast=limit).drop("spans", "h1", "h2").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows, items)


def test_drop_remove_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"Before, {item.upper()}! After.", "a"), (2, "clean text. Fine", "b"), (3, None, "c"), (2, "clean text. Fine", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["source"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["b", "b", "c"]
    got = sorted((r["row"]["source"], r["text"]) for r in decontaminate.remove_spans(docs, bench).collect())
    assert got == [("a", "Before, After."), ("b", "clean text. Fine"), ("b", "clean text. Fine"), ("c", None)]
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.scan(docs, bench.limit(0)).collect())
