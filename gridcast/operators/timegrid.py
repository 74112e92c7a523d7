"""Time dimension, alignment of granularities, the completed grid and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import minute_slot


def time_dimension(series: DataFrame, unit: str, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] id_time (dense, from 1), time: the distinct starts of a unit, over all rows or for every key of by.

    A numbered table is as long as the covered time, whatever the entities: it is what a task sorts.
    """
    start = F.date_trunc(unit, ts) if unit != "10min" else F.window(ts, "10 minutes").start
    times = series.select(*by, start.alias("time")).distinct()
    return times.select(*by, F.row_number().over(W.partitionBy(*by).orderBy("time")).cast("long").alias("id_time"), "time")


def join_times(series: DataFrame, times: DataFrame, max_broadcast: int = 2_000_000, on: str = "id_time") -> DataFrame:
    """Left join of facts to the time dimension, by id or time: broadcast while it has at most max_broadcast rows."""
    small = times.limit(max_broadcast + 1).count() <= max_broadcast
    return series.join(F.broadcast(times) if small else times, on, "left")


def with_time_keys(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds day, hr, mi (ten-minute slot), sec, dom."""
    t = F.col(ts)
    return rows.withColumns({"day": F.to_date(t), "hr": F.hour(t), "mi": minute_slot(t), "sec": F.second(t), "dom": F.dayofmonth(t)})


def align(day: DataFrame, hour: DataFrame, ten: DataFrame | None = None, keys: tuple[str, ...] = ("i", "day")) -> DataFrame:
    """Left joins of the finer series to the coarser ones, each on the full key of the coarser: no row fans out twice."""
    out = day.withColumnRenamed("nb", "nb_day").join(hour.withColumnRenamed("nb", "nb_hour"), list(keys), "left")
    return out if ten is None else out.join(ten.withColumnRenamed("nb", "nb_10min"), [*keys, "hr"], "left")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by a declared order, by partial aggregation rather than a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rows.columns if c not in keys))


def spine(keys: DataFrame, minutes: bool = False) -> DataFrame:
    """Every slot of every given (entity, day): 24 hours, or 24 x 6 ten-minute slots, generated from ranges."""
    out = keys.distinct().withColumn("hr", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return out.withColumn("mi", F.explode(F.sequence(F.lit(0), F.lit(5)))) if minutes else out


def complete(series: DataFrame, keys: list[str], slots: list[str]) -> DataFrame:
    """The series on its spine: one row a slot, null where the series has none."""
    return spine(series.select(*keys), "mi" in slots).join(series, [*keys, *slots], "left")


def complete_days(series: DataFrame, key: str = "i", day: str = "day") -> DataFrame:
    """(entity, day) pairs with no missing day between an entity's first and last."""
    span = series.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b")).alias(day))


def _filled(c: str, keys: list[str], slots: list[str], backward: bool) -> Column:
    up = W.partitionBy(*keys).orderBy(*slots).rowsBetween(W.unboundedPreceding, 0)
    out = F.last(c, ignorenulls=True).over(up)
    if backward:
        down = W.partitionBy(*keys).orderBy(*(F.desc(s) for s in slots)).rowsBetween(W.unboundedPreceding, 0)
        out = F.coalesce(out, F.last(c, ignorenulls=True).over(down))
    return out


def fill(grid: DataFrame, keys: list[str], slots: list[str], backward: bool = True) -> DataFrame:
    """Forward, then backward fill of every other column within one (entity, day): 144 rows a group at most."""
    rest = [c for c in grid.columns if c not in keys and c not in slots]
    return grid.select(*keys, *slots, *(_filled(c, keys, slots, backward).alias(c) for c in rest))
