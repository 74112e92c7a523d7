from collections import defaultdict

import pytest

from gridcast.llm import line_dedup


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    key = lambda d: (d is not None, d or 0)
    for d, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if line:
                sites[line] |= {s} - {None}
                first[line] = min(first.get(line, (key(d), k)), (key(d), k))
    out = []
    for d, t, s in rows:
        lines = None if t is None else t.split("\n")
        keep = [x for k, x in enumerate(lines or []) if len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (key(d), k)]
        out.append((str(d), str(s), None if t is None else "\n".join(keep), len(lines or []), len(lines or []) - len(keep)))
    return sorted(map(str, out))


@pytest.mark.parametrize("min_sites", [3, 60])
def test_against_exact_counts(spark, min_sites):
    rows = [(i, "\n".join([f"own {i}", " shared ", f"some {i % 7}", f"more {i % 2}", "", "shared"]), f"s{i % (min_sites + i % 3)}") for i in range(400)]
    rows += [(None, "shared\nx", "s1"), (900, None, "s2"), (901, "", None), (902, "shared", None), (903, "only\nonly", "s1"), (3, "\n".join(["dup"] * 3), "s1")]
    rows += [(5000 + i, "many " * 30 + "\nown", f"t{i}") for i in range(min_sites)] + [(6000 + i, "few", f"t{i}") for i in range(min_sites - 1)]
    docs = spark.createDataFrame([(d, t, s, 0) for d, t, s in rows], "doc_id long, text string, source string, pos int").repartition(4)
    got = line_dedup.clean(docs, min_sites).select("row.doc_id", "row.source", "text", "n_lines", "n_removed").collect()
    assert sorted(str((str(r[0]), str(r[1]), *r[2:])) for r in got) == brute(rows, min_sites)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x")] * 3 + [(2, "a\nc", "y")], "doc_id long, text string, source string")
    got = [(r["row"]["doc_id"], r["text"]) for r in line_dedup.clean(docs, 2).collect()]
    assert sorted(got) == [(1, "a\nb")] * 3 + [(2, "c")]
    assert line_dedup.clean(docs.limit(0), 2).count() == 0
