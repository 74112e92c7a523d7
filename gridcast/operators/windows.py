"""Count-based sliding windows as array columns, and what is derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STEPS

#: Window starts of one array. A block carries its starts' rows and the window length beyond: entities of any length
#: are dealt to many tasks, and no array is longer than this and a window.
BLOCK = 4096


def sliding_windows(rows: DataFrame, inputs: int, outputs: int, steps: dict[str, int] | None = None, key: str = "i", value: str = "y", strict: bool = False, block: int = BLOCK) -> DataFrame:
    """key, split, win_idx, x (inputs values), y (outputs values): windows of every split, `steps` apart.

    rows: key, split, pos, value. Splits shorter than a window give none, or ValueError when strict.
    """
    length = inputs + outputs
    spans = rows.groupBy(key, "split").agg(F.min("pos").alias("from"), F.count("*").alias("m"))
    if strict and spans.filter(F.col("m") < length).limit(1).count():
        raise ValueError(f"a split is shorter than the window of {length}")
    step = F.coalesce(*(F.when(F.col("split") == s, F.lit(k)) for s, k in (steps or STEPS).items()), F.lit(1))
    # a row goes to the block of its place and to those before that still need it
    at = rows.join(spans.filter(F.col("m") >= length), [key, "split"]).withColumn("at", F.col("pos") - F.col("from"))
    own = F.floor(F.col("at") / block)
    first = F.greatest(F.lit(0), F.floor((F.col("at") - (length - 1)) / block))
    at = at.select(key, "split", "m", "at", value, F.explode(F.sequence(first.cast("long"), own.cast("long"))).alias("block"))
    arrays = at.groupBy(key, "split", "block").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("at", value))).alias("v"))
    arrays = arrays.select(key, "split", "block", "m", F.transform("v", lambda s: s[value]).alias("v"), step.alias("step"))
    base = F.col("block") * block
    low = F.ceil(base / F.col("step")) * F.col("step")
    high = F.least(F.col("m") - length, base + block - 1)
    starts = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"), F.col("step").cast("long"))).otherwise(F.array().cast("array<long>"))
    cut = arrays.withColumn("start", F.explode(starts))
    from_ = (F.col("start") - F.col("block") * block + 1).cast("int")
    return cut.select(key, "split", F.expr("start div step").alias("win_idx"), F.slice("v", from_, inputs).alias("x"), F.slice("v", from_ + inputs, outputs).alias("y"))


def horizon(windows: DataFrame, steps: int) -> DataFrame:
    """Only the first steps of every target."""
    return windows.withColumn("y", F.slice("y", 1, steps))


def flatten(windows: DataFrame, column: str = "y", key: str = "i") -> DataFrame:
    """key, split, win_idx, step, v: one row a step."""
    return windows.select(key, "split", "win_idx", F.posexplode(column).alias("step", "v"))


def feature_target(rows: DataFrame, inputs: int, outputs: int, column: str = "w") -> DataFrame:
    """x and y from one array: the first inputs values, then outputs."""
    return rows.withColumns({"x": F.slice(column, 1, inputs), "y": F.slice(column, inputs + 1, outputs)}).drop(column)


def wide(windows: DataFrame, inputs: int, outputs: int, key: str = "i") -> DataFrame:
    """key, split, win_idx, x_0.., y_0..: the one-column-a-step layout, for export only."""
    xs = [F.get("x", F.lit(j)).alias(f"x_{j}") for j in range(inputs)]
    return windows.select(key, "split", "win_idx", *xs, *(F.get("y", F.lit(o)).alias(f"y_{o}") for o in range(outputs)))


def union_granularities(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of frames of equal columns, with the granularity each comes from."""
    named = [df.select(F.lit(g).alias("granularity"), "*") for g, df in parts.items()]
    return reduce(DataFrame.unionByName, named)
