import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gridcast.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out, counts = [], []
    for kind, p in BASE.items():
        n = 0
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if ok:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest())


def texts():
    rng = random.Random(11)
    out = [None, "", "a" * 20000, "1." * 5000, "é🙂 a@b.c_d@e.f x@y.z@q.r +1 (988) 555-2485", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111  1111111111111111", "0255.1.2.3 256.1.1.1 1.2.3.4.5.6.7.8 +" + " " * 3000]
    out += ["+1-2-3-4-5-6-7-8" * 30, "1-" * 3000 + "1", "a@b" + ".c" * 9000, "5 4111111111111111 5", "@a.b a@ a@b a@.b +12345678+1 234 567 8"]
    out += ["".join(rng.choice("ab1234567890@@...--  ++()\né_🙂") for _ in range(120)) for _ in range(400)]
    out += ["".join(rng.choice(["4111111111111111", " ", "-", "1", ".", "a@b.c", "+1 ", "(22) ", "1.2.3.4"]) for _ in range(30)) for _ in range(300)]
    return out


def test_base_spans_match_brute_force(spark):
    rows = [(i if i != 5 else None, t, 0) for i, t in enumerate(texts())] + [(3, "a@b.c", 1), (3, "a@b.c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = pii.digest(pii.find(docs)).toPandas()
    got = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.itertuples())
    assert got == sorted((-1 if i is None else i, *brute(t)) for i, t, _ in rows)


def entities(text):
    """(level, kind, what) of the protected entities of a text."""
    out = set()
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            hit, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                shared = {"email": hit.split("@")[-1].lower(), "ip": ".".join(hit.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
                out |= {(0, k, hit.lower()), (1, k, shared)}
    return out


def brute_terms(texts_, generalise=0.9, margin=0.0):
    """Spans of disclosing terms of every text, by counting all pairs."""
    distinct = set(texts_)
    own = {t: entities(t) for t in distinct}
    words = {t: set(re.findall(r"[^\W\d_]+", re.sub(BASE["email"], " ", t).lower())) for t in distinct}
    n, n_c, n_t, n_ct = len(distinct), Counter(), Counter(), Counter()
    for t in distinct:
        n_t.update(words[t])
    for t in distinct:
        n_c.update(own[t])
    held = set().union(*(words[t] for t in distinct if any(n_c[c] > 1 for c in own[t])), set())
    for t in distinct:
        n_ct.update((c, w) for c in own[t] if n_c[c] > 1 for w in words[t])
    tests = len(held) * sum(k > 1 for k in n_c.values())
    risk = {w for (c, w), k in n_ct.items() if k > 1 and n > n_c[c] and k * math.log2(n / n_c[c]) >= math.log2(tests) + margin and math.log2(k * n / (n_c[c] * n_t[w])) >= generalise * math.log2(n / n_c[c])}
    out = []
    for t in texts_:
        mail = [m.span() for m in re.finditer(BASE["email"], t)]
        spans = [m.span() for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in risk]
        out.append([f"term:{a}:{b}" for a, b in spans if not any(x < b and a < y for x, y in mail)])
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [rng.choice("abcdefg") + rng.choice("xyzäß") for _ in range(rng.choice([4, 30, 90]))]
        kind = rng.random()
        if kind < 0.12:
            words[rng.randrange(len(words)) : 0] = ["Agency" if rng.random() < 0.9 else "x", f"u{i}@agency.org"]
            words.append("headquarters")
        elif kind < 0.2:
            words.insert(2, f"+49 (30) 555 {i:04d}")
            words.append("Berlin")  # far from the number
        elif kind < 0.23:
            words += ["10.1.2.3", "kernel", "Kernel" if i % 2 else "KERNEL"]
        elif kind < 0.25:
            words += ["agency"]  # the term without an entity
        rows.append((i, " ".join(words)))
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(2000, "word " * 30_000 + "u7@agency.org agency"), (2001, "headquarters@agency.org x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in pii.digest(pii.find(docs)).collect()}
    want = brute_terms([t for _, t in rows])
    assert [got[i] for i, _ in rows] == want
    marked = {t[a:b].lower() for (_, t), spans in zip(rows, want) for a, b in (map(int, s.split(":")[1:]) for s in spans)}
    assert {"headquarters", "berlin", "kernel"} <= marked and sum(map(len, want)) > 100


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"filler{chr(97 + i % 7)}{chr(97 + i // 7)} the secretagent wrote to spy@agency.org about matters") for i in range(8)]
    rows += [(100 + i, f"the people wrote about {chr(97 + i % 26)}word{chr(97 + i % 11)} matters to someone{chr(97 + i % 5)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(found).collect()}
    assert "term" not in "".join(got[i] for i in got if i >= 100)
    at = rows[0][1].index("secretagent")
    assert f"term:{at}:{at + 11}" in got[0] and "email:" in got[0]
    clean = docs.join(found, "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("spans")).alias("clean"))
    clean = {r["doc_id"]: r["clean"] for r in clean.collect()}
    assert clean[0] == rows[0][1].replace("secretagent", "").replace("spy@agency.org", "[EMAIL]") and clean[150] == rows[58][1]


def test_empty(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
