"""Positions, ordered splits and per-entity min-max scaling fitted on the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import TRAIN_SHARE, VALIDATION_SHARE, check_shares
from ..functions.columns import scaled, unscaled


def positions(series: DataFrame, key: str = "i", day: str = "day", slots: tuple[str, ...] = ()) -> DataFrame:
    """Adds pos (from 0, by day and slot) and n (rows of the entity).

    Days are numbered on day counts, one row a day, and rows within a day: no task holds a whole entity.
    """
    counts = series.groupBy(key, day).agg(F.count("*").alias("__k"))
    entity = W.partitionBy(key)
    before = F.coalesce(F.sum("__k").over(entity.orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, day, before.alias("__skip"), F.sum("__k").over(entity).alias("n"))
    within = F.row_number().over(W.partitionBy(key, day).orderBy(*(slots or (day,)))) - 1
    rows = series.withColumn("__at", within).join(counts, [key, day])
    return rows.withColumn("pos", (F.col("__skip") + F.col("__at")).cast("long")).drop("__skip", "__at")


def split(placed: DataFrame, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE) -> DataFrame:
    """Adds split: the first floor(train n) rows, the next floor(validation n), the rest."""
    check_shares(train, validation)
    a = F.floor(F.col("n") * F.lit(float(train)))
    b = a + F.floor(F.col("n") * F.lit(float(validation)))
    return placed.withColumn("split", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test"))


def fit_scaler(parted: DataFrame, key: str = "i", value: str = "nb") -> DataFrame:
    """key, data_min, data_max of the training rows: the scaler registry."""
    train = parted.filter(F.col("split") == "train")
    x = F.col(value).cast("double")
    return train.groupBy(key).agg(F.min(x).alias("data_min"), F.max(x).alias("data_max"))


def _with(rows: DataFrame, scalers: DataFrame, key: str) -> DataFrame:
    return rows.join(scalers, key)  # a row an entity: adaptive execution broadcasts it while it is small


def transform(rows: DataFrame, scalers: DataFrame, key: str = "i", value: str = "nb", out: str = "y") -> DataFrame:
    placed = _with(rows, scalers, key)
    return placed.withColumn(out, scaled(F.col(value).cast("double"), F.col("data_min"), F.col("data_max"))).drop("data_min", "data_max")


def inverse(rows: DataFrame, scalers: DataFrame, key: str = "i", value: str = "y", out: str = "nb") -> DataFrame:
    placed = _with(rows, scalers, key)
    return placed.withColumn(out, unscaled(F.col(value), F.col("data_min"), F.col("data_max"))).drop("data_min", "data_max")


def inverse_arrays(rows: DataFrame, scalers: DataFrame, columns: tuple[str, ...], key: str = "i") -> DataFrame:
    """Array columns of scaled values in original units."""
    low, high = F.col("data_min"), F.col("data_max")
    placed = _with(rows, scalers, key)
    return placed.withColumns({c: F.transform(c, lambda v: unscaled(v, low, high)) for c in columns}).drop("data_min", "data_max")


def scaling(rows: DataFrame, mode: int = 0, scalers: DataFrame | None = None, key: str = "i", value: str = "nb", out: str = "y") -> tuple[DataFrame, DataFrame]:
    """One entry for the three uses: 0 fits on the training rows and transforms, 1 transforms, 2 inverts."""
    if mode not in (0, 1, 2):
        raise ValueError("mode is 0 (fit and transform), 1 (transform) or 2 (inverse)")
    if mode and scalers is None:
        raise ValueError("a fitted scaler table is needed unless mode is 0")
    if mode == 0:
        scalers = fit_scaler(rows, key, value)
    return (inverse if mode == 2 else transform)(rows, scalers, key, value, out), scalers
