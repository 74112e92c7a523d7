"""Continuity of the time dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: part of the time, ids a cycle, fall at its end, regular difference
CYCLES = {"day": ("dayofmonth", 31, -30, 1), "hour": ("hour", 24, -23, 1), "10min": ("minute", 6, -50, 10)}


def lag_diff(times: DataFrame, unit: str, by: tuple[str, ...] = (), after: int = 0) -> DataFrame:
    """[by,] id_time, diff: the unit's part of the time less that of the row before, of ids beyond `after`.

    The time table is one row a slot, so what a task sorts is as long as the covered time.
    """
    part = F.expr(f"{CYCLES[unit][0]}(time)")
    diff = (part - F.lag(part).over(W.partitionBy(*by).orderBy("id_time"))).cast("int")
    return times.filter(F.col("id_time") > after).select(*by, "id_time", diff.alias("diff")).filter(F.col("diff").isNotNull())


def gap_report(times: DataFrame, unit: str, by: tuple[str, ...] = (), after: int = 0) -> DataFrame:
    """Rows whose difference is neither regular nor the fall at the end of a cycle."""
    _, cycle, fall, regular = CYCLES[unit]
    ends = (F.col("id_time") % cycle == 0) & (F.col("diff") == fall)
    return lag_diff(times, unit, by, after).filter(~(ends | (F.col("diff") == regular)))


def real_gaps(times: DataFrame, seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] id_time, gap in seconds of rows that don't follow their predecessor by one unit of the time itself.

    What a task sorts is one time table, as long as the covered time.
    """
    at = F.unix_timestamp("time")
    gaps = times.select(*by, "id_time", (at - F.lag(at).over(W.partitionBy(*by).orderBy("id_time"))).alias("gap"))
    return gaps.filter(F.col("gap").isNotNull() & (F.col("gap") != seconds))
