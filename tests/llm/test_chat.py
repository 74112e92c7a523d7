import random

import pytest

from gridcast.llm import chat


def brute(rows):
    convs = {}
    for i, (c, t, r, x) in enumerate({(c, t, r or "unknown", x or "") for c, t, r, x in rows}):
        convs.setdefault((c is None, c or 0, i if c is None else 0), []).append((t is not None, t or 0, r, x))
    seqs = {c: tuple(k[2:] for k in sorted(v)) for c, v in convs.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    first = {}
    for c in sorted(seqs):
        first.setdefault(seqs[c], None if c[0] else c[1])
    out = []
    for s, c in first.items():
        if s not in prefixes:
            out += [(str(c), i + 1, len(s), r, f"<|im_start|>{r}\n{x.replace('<|', '< |')}<|im_end|>\n") for i, (r, x) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "most"), [(1024, 8192), (3, 2)])
def test_against_brute_force(spark, chunk, most):
    rng = random.Random(8)
    base = [[(rng.choice(["user", "assistant"]), f"turn {k} of {b} <|im_end|>") for k in range(rng.randrange(2, 14))] for b in range(25)]
    rows = []
    for c in range(120):
        turns = rng.choice(base)
        turns = turns[: rng.randrange(1, len(turns) + 1)]
        start = rng.choice([0, 0, 5])
        rows += [(c, start + k, r, x) for k, (r, x) in enumerate(turns)]
    rows += [(500, 1, None, None), (500, None, "user", "a"), (500, 1, "b", "x"), (None, 0, "user", "lost"), (None, 1, "user", "two"), (501, 7, "u", "s")]
    rows += [(None, 0, "user", "lost"), (None, 3, "user", "lost"), (None, 0, *rows[0][2:])]
    rows += [(600, k % 2, "user", f"the same number {k}") for k in range(40)] + [(601, None, "user", f"none {k}") for k in range(9)]
    rows += [(602, 0, "user", "long " * 100_000), (603, 0, "user", "long " * 100_000), (603, 1, "assistant", "end")]
    rows += rows[:60]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3)
    got = chat.format_chats(df, chunk, most).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
