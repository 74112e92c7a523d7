"""Chat formatting after cumulative-snapshot collapse, in DataFrame operations only.

Logs hold a conversation again and again as it grows. Every turn gets two 64-bit hashes of its position, role and
text, and the exclusive or of those up to a turn is the hash of that turn prefix. A conversation whose whole hash is a
prefix hash of a longer one is a snapshot of it: an anti-join drops it. Of equal conversations the smallest id stays.
Each turn of what is left is then rendered between control tokens; the turns in order are the training text.

A conversation is dealt to tasks in chunks of `chunk` turn numbers, and chunks of more than `most` rows, as repeated
numbers give, by ranges of the order of their turns. Counts and hashes of chunks carry over to the next, so no
conversation has to fit a task; neither do its rendered turns, which stay rows.

Cases: rows equal in all four columns are one turn; turns of one number are ordered by role, then text; null numbers
come first; null text is empty, null role is `unknown`; a row without conversation id is a conversation of its own, of
one turn; control tokens within a text are broken up; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import around, scratch, write_table

START, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(role: Column, text: Column) -> Column:
    """One turn between control tokens."""
    return F.concat(F.lit(START), _plain(role), F.lit("\n"), _plain(text), F.lit(END + "\n"))


#: What tells conversations apart: whether the id is null, the id, and of a row without one two hashes of it.
CONV = ["nc", "c", "k1", "k2"]


def _chunked(rows: DataFrame, chunk: int, most: int) -> DataFrame:
    """Adds chunk and part, by which rows of a conversation are dealt out in the order of its turns."""
    rows = write_table(rows.withColumn("chunk", F.coalesce(F.expr(f"turn div {chunk}"), F.lit(-(1 << 62)))), "turns")
    large = rows.groupBy(*CONV, "chunk").agg(F.count("*").alias("k")).filter(F.col("k") > most).select(*CONV, "chunk")
    large = write_table(large, "large")
    few = rows.join(large, [*CONV, "chunk"], "left_anti").withColumn("part", F.lit(0))
    many = rows.join(large, [*CONV, "chunk"], "left_semi").repartitionByRange(*CONV, "turn", "role", "text")
    return few.unionByName(many.withColumn("part", F.spark_partition_id()))


def maximal_turns(turns: DataFrame, chunk: int = 1024, most: int = 8192, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), n, role, text of every turn of conversations that are no prefix of another."""
    outer = around()
    with scratch(turns.sparkSession):
        return _maximal(turns, chunk, most, [conv_col, turn_col, role_col, text_col], outer)


def _maximal(turns: DataFrame, chunk: int, most: int, names: list[str], outer: list) -> DataFrame:
    conv_col, turn_col, role_col, text_col = map(F.col, names)
    rows = turns.select(
        conv_col.isNull().alias("nc"),
        F.coalesce(conv_col, F.lit(0)).cast("long").alias("c"),
        turn_col.cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("unknown")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumns({f"k{i}": F.when(F.col("nc"), F.xxhash64(F.lit(i), "turn", F.length("role"), "role", "text")).otherwise(F.lit(0)) for i in (1, 2)})
    keys = [*CONV, "chunk", "part"]
    own = W.partitionBy(*keys).orderBy("turn", "role", "text")
    rows = write_table(_chunked(rows, chunk, most).withColumn("at", F.row_number().over(own)), "numbered")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("k"))
    conv = W.partitionBy(*CONV)
    before = conv.orderBy("chunk", "part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"), F.sum("k").over(conv).alias("n"))
    rows = rows.join(counts, keys).withColumn("pos", F.col("skip") + F.col("at"))
    rows = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "pos", F.length("role"), "role", "text") for i in (1, 2)})
    sums = rows.groupBy(*keys).agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select(*keys, *(F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    run = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    prefix = rows.select(*keys, "at", "pos", "n", *(F.bit_xor(f"h{i}").over(run).alias(f"h{i}") for i in (1, 2))).join(sums, keys)
    prefix = prefix.select(*CONV, "pos", "n", *(F.col(f"h{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)))
    prefix = write_table(prefix, "prefix_hashes")
    whole = prefix.filter("pos = n").groupBy("n", "h1", "h2").agg(F.min(F.struct(*CONV)).alias("id"))
    parts = prefix.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = whole.join(parts, ["n", "h1", "h2"], "left_anti").select("id.*")
    rows = rows.join(kept, CONV)
    return write_table(rows.select(F.when(~F.col("nc"), F.col("c")).alias("conv"), "pos", "n", "role", "text"), "maximal", outer)


def format_chats(turns: DataFrame, chunk: int = 1024, most: int = 8192, conv_col: str = "conv_id", **names) -> DataFrame:
    """conv id, position, n_turns, role, rendered of every turn of the maximal conversations."""
    rows = maximal_turns(turns, chunk, most, conv_col, **names)
    return rows.select(F.col("conv").alias(conv_col), F.col("pos").alias("position"), F.col("n").alias("n_turns"), "role", render(F.col("role"), F.col("text")).alias("rendered"))


#: The same for the test table conversations, by comparing the prefixes themselves.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE CAST(conv_id AS VARCHAR) END AS conv FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv) AS n FROM k),
s AS (SELECT conv, conv_id, pos, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM p),
whole AS (SELECT arg_min(conv, coalesce(conv_id, 9223372036854775807)) AS conv, n, prefix FROM s WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT conv FROM whole w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pos < s.n AND s.pos = w.n AND s.prefix = w.prefix))
SELECT p.conv_id, CAST(pos AS BIGINT) AS position, CAST(n AS BIGINT) AS n_turns, role,
       '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN kept USING (conv)
"""
