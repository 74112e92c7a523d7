"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers found by fixed patterns. Each
entity is protected as itself and as its class, so that entities which occur once are covered: the domain of an
address, the first half of an IP address, the issuer's digits of a card, country and area digits of a phone number.

The corpus then says how strongly other terms (runs of letters outside of addresses) reveal a protected entity c. Over
all distinct texts, whole, n(c, t) texts hold both; PMI(c; t) = log2 n(c,t) n / (n(c) n(t)), and c itself has log2
n / n(c) bits of information. A term discloses c where PMI reaches `generalise` of c's information, and where the
n(c,t) joint texts together carry enough bits to tell it from chance: n(c,t) log2 n / n(c) must exceed by `margin` the
bits that pick one of all pairs of an entity and a term, so that about 2^-margin pairs are expected to do so by chance
in the whole corpus, of any size. That asks for two joint texts of a rare entity and for more of a common one. A disclosing term is generalised, or removed where PMI reaches `remove` of
c's information, wherever it occurs in any text. Such terms are added spans of kind `term`.

Spans depend on a text alone, so terms travel under 128 bits of hash of the text. Texts are scanned for entities (and
the terms beside them), for the document counts of candidate terms, and for the places of disclosing ones; only the
last moves texts, each distinct one once.

Cases: null text is empty; ids may be null or repeat (rows are told apart); entities or terms in one text count once
and equal texts count once; overlaps between base kinds stay, terms that overlap an address are not marked; a text
without findings has empty spans; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import around, scratch, write_table

#: Fixed patterns, each written so that a failed start isn't tried again within the same run of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
OCTET = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Candidate terms (16 bytes each) up to which they are sent to all executors.
MAX_BROADCAST = 500_000
SAME = ["s1", "s2"]


def _valid() -> Column:
    """Whether a hit of its kind stands the kind's test."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.forall(F.split("hit", r"\."), lambda p: p.rlike(OCTET)))
        .when(F.col("kind") == 2, F.call_function("luhn_check", digits))
        .otherwise(F.length(digits).between(8, 15))
    )


def _class() -> Column:
    """What of an entity it shares with others of its kind."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    return (
        F.when(F.col("kind") == 0, F.lower(F.substring_index("hit", "@", -1)))
        .when(F.col("kind") == 1, F.substring_index("hit", ".", 2))
        .when(F.col("kind") == 2, F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.lit(4)))
    )


def _same(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), text).alias(s) for i, s in enumerate(SAME, 1)]


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text, in small letters, outside of addresses."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.transform(F.array_remove(F.array_distinct(F.split(F.lower(plain), r"\P{L}+")), ""), lambda t: F.xxhash64(t))


def _hit(kind: int, gaps: str):
    """One hit, with the length of the gap before it."""
    return lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), h.alias("hit"), F.length(F.get(gaps, i)).alias("gap"))


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of kind -1 for every document, with its terms if it has hits, and one for every hit with its place."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<kind:int,i:int,hit:string,gap:int>>")
    found, some = [F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit("").alias("hit"), F.lit(0).alias("gap")))], F.lit(False)
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        hits, gaps = f"hits_{kind}", f"gaps_{kind}"
        tried = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        rows = rows.withColumn(hits, F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        rows = rows.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)))
        found.append(F.when(F.size(hits) > 0, F.transform(hits, _hit(k, gaps))).otherwise(empty))
        some |= F.coalesce(F.size(hits) > 0, F.lit(False))
    rows = rows.select("row", "id", *_same(F.col("text")), F.when(some, _terms(F.col("text"))).alias("terms"), F.inline(F.concat(*found)))
    return rows.withColumn("terms", F.when(F.col("kind") < 0, F.col("terms")))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, s1, s2 of every document (kind -1, with terms) and of every valid hit, with kind, hit, from and to."""
    hits = _hits(docs, id_col, text_col)
    order = W.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("hit")).over(order.rowsBetween(W.unboundedPreceding, 0))
    hits = hits.withColumn("to", end.cast("int")).withColumn("from", (F.col("to") - F.length("hit")).cast("int"))
    return hits.filter((F.col("kind") < 0) | _valid()).select("row", "id", *SAME, "terms", "kind", "hit", "from", "to")


def disclosing(docs: DataFrame, hits: DataFrame, generalise: float, remove: float, margin: float, text_col: str) -> DataFrame:
    """t (hash of a term), action of every term that discloses a protected entity, and the texts (s1, s2) it is in."""
    entities = hits.filter("kind >= 0").select(*SAME, F.explode(F.array(F.xxhash64(F.lit(0), "kind", F.lower("hit")), F.xxhash64(F.lit(1), "kind", _class()))).alias("entity")).distinct()
    n_c = entities.groupBy("entity").agg(F.count("*").alias("n_c")).filter("n_c > 1")  # n(c, t) = 1 is never enough
    entities = write_table(entities.join(n_c.select("entity"), "entity", "left_semi"), "entities")
    n_c = write_table(n_c, "entity_counts")
    texts = hits.filter("kind < 0").select(*SAME).distinct()
    n = texts.agg(F.count("*").alias("n"))  # one row

    # terms of the texts that hold an entity
    held = hits.filter("kind < 0").select(*SAME, F.explode("terms").alias("t")).join(entities.select(*SAME).distinct(), SAME, "left_semi").distinct()
    held = write_table(held, "terms")
    # a term is in as many texts at least as it is in texts with an entity: most common words end here
    at_least = held.groupBy("t").agg(F.count("*").alias("n_t"))
    tests = F.broadcast(at_least.agg(F.count("*").alias("n_terms")).crossJoin(n_c.agg(F.count("*").alias("n_entities"))).crossJoin(n))  # one row
    info = F.log2(F.col("n") / F.col("n_c"))
    share = F.log2(F.col("n_ct") * F.col("n") / (F.col("n_c") * F.col("n_t"))) / F.when(F.col("n") > F.col("n_c"), info)
    pairs = held.join(entities, SAME).groupBy("entity", "t").agg(F.count("*").alias("n_ct")).filter("n_ct > 1")
    pairs = pairs.join(n_c, "entity").crossJoin(tests).filter(F.col("n_ct") * info >= F.log2("n_terms") + F.log2("n_entities") + margin)
    pairs = write_table(pairs.join(at_least, "t").filter(share >= generalise).select("entity", "t", "n_ct", "n_c", "n"), "pairs")

    # document counts of the remaining terms over all texts
    text = F.coalesce(F.col(text_col), F.lit(""))
    asked = pairs.select("t").distinct()
    if asked.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        asked = F.broadcast(asked)
    uses = docs.select(*_same(text), F.explode(_terms(text)).alias("t")).join(asked, "t", "left_semi").distinct()
    uses = write_table(uses, "uses")
    n_t = uses.groupBy("t").agg(F.count("*").alias("n_t"))
    risk = pairs.join(n_t, "t").withColumn("share", share).filter(F.col("share") >= generalise)
    risk = risk.groupBy("t").agg(F.when(F.max("share") >= remove, "remove").otherwise("generalise").alias("action"))
    return uses.join(risk, "t")


def _places(docs: DataFrame, marked: DataFrame, text_col: str) -> DataFrame:
    """s1, s2, from, to, action of every occurrence of marked terms (s1, s2, t, action) in their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*_same(text), text.alias("text")).groupBy(*SAME).agg(F.first("text").alias("text"))
    asked = marked.groupBy(*SAME).agg(F.collect_list("t").alias("asked"))
    rows = texts.join(asked, SAME).select(*SAME, "asked", F.regexp_extract_all("text", F.lit(r"\p{L}+|\P{L}+"), F.lit(0)).alias("runs"))
    rows = rows.select(*SAME, "asked", F.transform("runs", lambda r: F.length(r)).alias("k"), F.transform("runs", lambda r: F.xxhash64(F.lower(r))).alias("t"))
    places = F.transform("t", lambda t, i: F.when(F.array_contains("asked", t), i))
    rows = rows.select(*SAME, "k", "t", F.array_compact(places).alias("at"))
    # a hit, with the length of what lies between the one before and its end
    since = lambda i, j: F.coalesce(F.get("at", j - 1), F.lit(-1)) + 2
    width = lambda i, j: F.aggregate(F.slice("k", since(i, j), i + 2 - since(i, j)), F.lit(0), lambda a, x: a + x)
    hits = F.transform("at", lambda i, j: F.struct(i.alias("i"), F.get("t", i).alias("t"), F.get("k", i).alias("k"), width(i, j).alias("width")))
    rows = rows.select(*SAME, F.inline(hits))
    end = F.sum("width").over(W.partitionBy(*SAME).orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("to", end).join(marked, [*SAME, "t"])
    return rows.select(*SAME, (F.col("to") - F.col("k")).alias("from"), "to", "action")


def find(docs: DataFrame, generalise: float = 0.9, remove: float = 0.99, margin: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: array of (kind, from, to, action), sorted, for every row of docs."""
    outer = around()
    with scratch(docs.sparkSession):
        hits = write_table(_base(docs, id_col, text_col), "pii", outer)
        marked = write_table(disclosing(docs, hits, generalise, remove, margin, text_col), "marked")
        places = _places(docs, marked, text_col)
        places = places.groupBy(*SAME).agg(F.collect_list(F.struct(F.lit(len(KINDS) - 1).alias("kind"), "from", "to", "action")).alias("terms"))
        places = write_table(places, "places", outer)
    spans = F.struct("kind", "from", "to", F.lit("generalise").alias("action"))
    base = hits.groupBy("row").agg(F.first("id").alias("id"), *(F.first(s).alias(s) for s in SAME), F.collect_list(F.when(F.col("kind") >= 0, spans)).alias("base"))
    rows = base.join(places, SAME, "left")
    emails = F.filter("base", lambda b: b["kind"] == 0)
    apart = lambda t: ~F.exists("emails", lambda b: (b["from"] < t["to"]) & (t["from"] < b["to"]))
    rows = rows.withColumn("emails", emails)
    terms = F.when(F.size("emails") > 0, F.filter("terms", apart)).otherwise(F.col("terms"))
    none = F.array().cast("array<struct<kind:int,from:int,to:int,action:string>>")
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat("base", F.coalesce(terms, none))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, counts by kind, base_sha256, spans as text."""
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["from"].cast("string"), F.lit(":"), s["to"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, line), ",")
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *counts[:-1], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), counts[-1])


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's label, or by nothing where the action is remove.

    Spans that overlap merge into one, under the label of the first.
    """
    labels = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (k, LABELS[kind])))
    state = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"), s["action"].alias("action"))))

    def step(acc, s):
        label = F.when(s["action"] == "remove", F.lit("")).otherwise(F.element_at(labels, s["kind"]))
        fresh = F.concat(F.substring(text, acc["at"] + 1, s["from"] - acc["at"]), label)
        return F.when(s["from"] < acc["at"], F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["to"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["parts"], F.array(fresh)).alias("parts"), s["to"].alias("at"))
        )

    return F.aggregate(by_place, state, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
