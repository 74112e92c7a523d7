"""Benchmark decontamination by word n-grams, in DataFrame operations only.

Item texts become windows of `n` consecutive words (an item of fewer words is one window). The windows form a hash
table that is broadcast while it has at most `max_broadcast` of them. Beyond, it is joined by shuffling the places that
pass a broadcast bitmap of window hashes, whose size is fixed. Each document
yields the hash of its window at every word; a hit is verified word by word; a word inside any verified occurrence is
hit.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after A-Z become a-z.

Cases: null and empty texts have no words; items without words, id or text are left out; equal items count once per
id; equal rows of documents are rows of their own; without windows nothing is contaminated; an empty table gives no
rows; other columns aren't carried, except by `drop_contaminated` and `remove_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The character class of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows (about 200 bytes each) up to which the benchmark is broadcast.
MAX_BROADCAST = 200_000
#: Beyond, positions first pass a bitmap of 2^BITMAP bits (2^20 longs).
BITMAP = 26


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """m (words), gram (joined by spaces), items (ids as strings) of every distinct window."""
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("m", F.least(F.lit(n), F.size("words")))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1))
    grams = items.select("item", "m", "words", at.alias("at")).select("item", "m", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("m"))).alias("gram"))
    return grams.groupBy("m", "gram").agg(F.collect_set("item").alias("items"))


def _hash(m: int) -> Column:
    """Of the m words from pos on; null where the document ends before."""
    return F.when((F.col("pos") >= 0) & (F.col("pos") + m <= F.col("n_words")), F.xxhash64(*(F.get(F.col("words"), F.col("pos") + k) for k in range(m))))


def _near(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows at -1 and those whose hash is among the table's by a bitmap of 2^BITMAP bits.

    The bitmap is broadcast as at most 2^(BITMAP - 6) longs, so its size doesn't follow the benchmark's. It lets all
    windows of the benchmark through, and of others a share of at most windows / 2^BITMAP.
    """
    place = lambda h: F.pmod(F.col(h), F.lit(1 << BITMAP))
    bits = table.select(place("gh").alias("at")).select(F.expr("at div 64").alias("cell"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))
    bits = bits.groupBy("cell").agg(F.bit_or("bit").alias("mask"))
    rows = rows.withColumn("at", place("h"))
    rows = rows.join(F.broadcast(bits), F.expr("at div 64") == F.col("cell"), "left")
    return rows.filter((F.col("pos") == -1) | F.expr("mask & shiftleft(1L, CAST(at % 64 AS INT)) <> 0")).drop("at", "cell", "mask")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word ranges), h1, h2 (of id and text) per row."""
    grams = windows(benchmark, n, item_col, item_text)
    sizes = {r["m"]: r["k"] for r in grams.groupBy("m").agg(F.count("*").alias("k")).collect()}  # at most n rows
    lengths = sorted(sizes) or [n]
    key = [F.col(id_col), F.col(text_col)]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(F.lit(1), *key).alias("h1"),
        F.xxhash64(F.lit(2), *key).alias("h2"),
        words(F.col(text_col)).alias("words"),
    )
    rows = rows.withColumn("n_words", F.size("words"))
    # a row at -1 for the document itself, then one for every word
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    if len(lengths) == 1:
        rows = rows.withColumns({"m": F.lit(lengths[0]), "h": _hash(lengths[0])})
    else:
        rows = rows.withColumn("w", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), _hash(m).alias("h")) for m in lengths))))
        rows = rows.filter((F.col("pos") >= 0) | (F.col("w.m") == lengths[0])).withColumns({"m": F.col("w.m"), "h": F.col("w.h")})
    gram = F.concat_ws(" ", F.slice("words", F.col("pos") + 1, F.col("m")))
    of_gram = F.expr("CASE m " + " ".join(f"WHEN {m} THEN xxhash64({', '.join(f'get(parts, {k})' for k in range(m))})" for m in lengths) + " END")
    table = grams.withColumn("parts", F.split("gram", " ")).select(F.col("m").alias("gm"), "gram", "items", of_gram.alias("gh"))
    if sum(sizes.values()) <= max_broadcast:
        # the words are put together only where the hash is met
        rows = rows.join(F.broadcast(table), (F.col("h") == F.col("gh")) & (F.col("m") == F.col("gm")), "left")
        rows = rows.withColumn("items", F.when(F.col("gram") == gram, F.col("items")))
    else:
        rows = _near(rows, table)
        # a document's own row goes by a key that no window has, so that these rows are dealt evenly
        own = F.concat(F.lit("\0"), F.col("row").cast("string"))
        rows = rows.select("row", "id", "h1", "h2", "n_words", "pos", "m", F.when(F.col("pos") >= 0, gram).otherwise(own).alias("g"))
        rows = rows.join(table.drop("gh"), (F.col("g") == F.col("gram")) & (F.col("m") == F.col("gm")), "left")
    rows = rows.filter((F.col("pos") == -1) | F.col("items").isNotNull())
    found = rows.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("h1").alias("h1"),
        F.first("h2").alias("h2"),
        F.first("n_words").cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("m")).alias("end")))).alias("hits"),
        F.collect_set("items").alias("items"),
    )
    items = F.sort_array(F.array_distinct(F.flatten("items")))
    spans = F.aggregate(
        F.sort_array("hits"),
        F.array().cast("array<struct<pos:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["pos"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["pos"].alias("pos"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.withColumns({"items": items, "spans": F.when(F.size("hits") > 0, spans).otherwise(F.array().cast("array<struct<pos:int,end:int>>"))})
    n_hit = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["pos"]).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "spans",
        "h1",
        "h2",
    )


def _with_scan(docs: DataFrame, found: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    key = [docs[id_col], docs[text_col]]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(1), *key).alias("h1"), F.xxhash64(F.lit(2), *key).alias("h2"))
    return rows.join(found, ["h1", "h2"], how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item."""
    found = scan(docs, benchmark, n, id_col=id_col, text_col=text_col, **names).filter("contaminated").select("h1", "h2")
    return _with_scan(docs, found, "left_anti", id_col, text_col).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """row (struct of all columns of docs) and text, from which hit words go with what follows each up to the next word."""
    found = scan(docs, benchmark, n, id_col=id_col, text_col=text_col, **names).filter("contaminated")
    rows = _with_scan(docs, found.select("h1", "h2", "spans").dropDuplicates(["h1", "h2"]), "left", id_col, text_col)
    text = F.col(f"row.{text_col}")
    broad = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # with A-Z: the words of the text as it is
    rows = rows.withColumns({"parts": F.regexp_extract_all(text, F.lit(broad), F.lit(0)), "gaps": F.split(text, broad, -1)})
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["end"] - 1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), hit)
    rest = F.concat(F.get("gaps", F.lit(0)), F.array_join(F.transform(keep, lambda i: F.concat(F.get("parts", i), F.get("gaps", i + 1))), ""))
    return rows.select("row", F.when(F.col("spans").isNull(), text).otherwise(rest).alias("text"))


#: The same for the test tables; an item's windows are told from longer words by spaces around every word.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
grams AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
ms AS (SELECT DISTINCT m FROM grams),
hits AS (
  SELECT a.doc_id, a.i, g.m, g.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM places, ms WHERE i + m - 1 <= len(w)) a
  JOIN grams g ON a.gram = g.gram AND a.m = g.m
),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
