"""Which entities have a usable series: counts, quantile fences and a status by priority, all in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FENCE, HIGH_QUANTILE, LOW_QUANTILE, MIN_HISTORY


def quantile_bounds(series: DataFrame, key: str = "id", value: str = "nb") -> DataFrame:
    """key, q20, q80, lo, hi: exact quantiles and the fences FENCE times their distance beyond."""
    x = F.col(value).cast("double")
    q = series.groupBy(key).agg(F.percentile(x, LOW_QUANTILE).alias("q20"), F.percentile(x, HIGH_QUANTILE).alias("q80"))
    reach = FENCE * (F.col("q80") - F.col("q20"))
    return q.withColumns({"lo": F.col("q20") - reach, "hi": F.col("q80") + reach})


def screen(series: DataFrame, key: str = "id", value: str = "nb", min_history: int = MIN_HISTORY) -> DataFrame:
    """key, n, q20, q80, status: few, null, zero_variance, negative, outlier or valid, the first that applies."""
    x = F.col(value).cast("double")
    per = series.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(x.isNull()).alias("nulls"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.percentile(x, LOW_QUANTILE).alias("q20"),
        F.percentile(x, HIGH_QUANTILE).alias("q80"),
    )
    reach = FENCE * (F.col("q80") - F.col("q20"))
    status = (
        F.when(F.col("n") < min_history, "few")
        .when(F.col("nulls") > 0, "null")
        .when(F.col("low") == F.col("high"), "zero_variance")
        .when(F.col("low") < 0, "negative")
        .when((F.col("high") > F.col("q80") + reach) | (F.col("low") < F.col("q20") - reach), "outlier")
        .otherwise("valid")
    )
    return per.select(key, "n", "q20", "q80", status.alias("status"))


def summary(screened: DataFrame) -> DataFrame:
    """status, n: entities of each status."""
    return screened.groupBy("status").agg(F.count("*").alias("n"))


def outlier_rows(series: DataFrame, key: str = "id", value: str = "nb") -> DataFrame:
    """The rows of series outside their entity's fences."""
    rows = series.join(quantile_bounds(series, key, value), key)
    return rows.filter((F.col(value) > F.col("hi")) | (F.col(value) < F.col("lo"))).select(*series.columns)


def keep_valid(series: DataFrame, screened: DataFrame, key: str = "id", statuses: tuple[str, ...] = ("valid",)) -> DataFrame:
    """Rows of entities with one of the statuses (a semi-join)."""
    return series.join(screened.filter(F.col("status").isin(*statuses)).select(key), key, "left_semi")


def exclude(series: DataFrame, entities: list[str], key: str = "id") -> DataFrame:
    """Rows of all entities but the listed ones (an anti-join; the list is configuration)."""
    gone = series.sparkSession.createDataFrame([(str(e),) for e in entities], "gone string")
    return series.join(F.broadcast(gone), series[key].cast("string") == F.col("gone"), "left_anti")


def min_length(series: DataFrame, inputs: int, outputs: int, key: str = "id") -> DataFrame:
    """key, n of entities long enough for windows: more than ten times a window."""
    return series.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 10 * (inputs + outputs))
