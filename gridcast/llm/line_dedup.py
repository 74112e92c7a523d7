"""Cross-site boilerplate lines by distinct-site spread.

A line is what stands between line feeds, trimmed of spaces; lines are told apart by 128 bits of hash. Per line, one
HyperLogLog sketch of the sites it is seen on merges by aggregation, so a hot line or site is summed where it is read.
Lines whose estimate is clearly above `min_sites` are boilerplate; for those near it the distinct sites are counted
exactly. Every occurrence of a boilerplate line is removed but the first: that in the row of the smallest id, there
the first position. So no text is lost to the corpus as a whole.

Cases: empty lines are never boilerplate; null text has no line and stays null; a null site adds no site; null ids
come before all others; equal rows (same id and text) are one row here and keep or lose the same lines; an empty
table gives no rows; columns that aren't named are carried by `clean` and play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Share of the threshold, and sites at least, within which an estimate is settled by an exact count (lgK 12: 1.6 % error).
NEAR_SHARE, NEAR_SITES = 0.1, 2


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, d1, d2 (of the row), site, pos, h1, h2 (of the line) of every line that isn't empty."""
    key = [F.col(id_col), F.col(text_col)]
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.lit(1), *key).alias("d1"),
        F.xxhash64(F.lit(2), *key).alias("d2"),
        F.col(site_col).alias("site"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"),
    )
    rows = rows.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return rows.select("id", "d1", "d2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h1, h2 and the first occurrence (struct id, d1, d2, pos) of every line on at least min_sites sites."""
    lines = _lines(docs, id_col, text_col, site_col)
    band = max(NEAR_SITES, round(NEAR_SHARE * min_sites))
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("sites"),
        F.min(F.struct("id", "d1", "d2", "pos")).alias("first"),
    )
    spread = write_table(spread.filter(F.col("sites") >= max(1, min_sites - band)), "lines")
    near = spread.filter(F.col("sites") <= min_sites + band)
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= min_sites)
    near = near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return spread.filter(F.col("sites") > min_sites + band).unionByName(near).select("h1", "h2", "first")


def clean(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """row (struct of all columns of docs), text without boilerplate, n_lines, n_removed of every row of docs."""
    flagged = write_table(boilerplate(docs, min_sites, id_col, text_col, site_col), "boilerplate")
    lines = _lines(docs, id_col, text_col, site_col).drop("site").join(flagged, ["h1", "h2"])
    drop = lines.filter(~F.struct("id", "d1", "d2", "pos").eqNullSafe(F.col("first")))
    drop = drop.groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop"))
    key = [docs[id_col], docs[text_col]]
    rows = docs.select(
        F.struct("*").alias("row"),
        docs[text_col].alias("text"),
        F.xxhash64(F.lit(1), *key).alias("d1"),
        F.xxhash64(F.lit(2), *key).alias("d2"),
    )
    rows = rows.join(drop, ["d1", "d2"], "left").withColumn("lines", F.split("text", "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    rest = F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n")
    return rows.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: The same for the test table documents, counted exactly.
SQL = """
WITH lines AS (
  SELECT doc_id, source, pos, trim(line, ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), spread AS (
  SELECT line, count(DISTINCT source) AS sites FROM lines WHERE line <> '' GROUP BY line
), ranked AS (
  SELECT l.doc_id, l.pos, row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) AS k
  FROM lines l JOIN spread s ON l.line = s.line AND s.sites >= 5
), gone AS (SELECT doc_id, pos FROM ranked WHERE k > 1),
split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), rest AS (
  SELECT s.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM rest
"""
