"""Deterministic baseline forecasts, pairing of truth and prediction, and grouped error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import all_metrics, nrmse_of_range, rmse


def lagged(scaled: DataFrame, lag: int, key: str = "i", value: str = "y") -> DataFrame:
    """Test rows with yp, the value `lag` steps before: an equi-join on (entity, position), so no entity sits in one task."""
    before = scaled.select(key, (F.col("pos") + lag).alias("pos"), F.col(value).alias("yp"))
    return scaled.filter(F.col("split") == "test").join(before, [key, "pos"]).select(key, "pos", F.col(value).alias("y"), "yp")


def window_mean(windows: DataFrame) -> DataFrame:
    """Adds yp: the mean of x for every step of y."""
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return windows.withColumn("yp", F.transform("y", lambda _: mean))


def pair(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and prediction of the same keys side by side; row order plays no part."""
    return truth.join(predictions, keys)


def metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """rmse, mae, nrmse, smape over (y, yp), by any columns."""
    return pairs.groupBy(*by).agg(*(c.alias(k) for k, c in all_metrics().items()))


def metrics_cube(pairs: DataFrame, *by: str) -> DataFrame:
    """The same for every combination of the columns, null standing for all."""
    return pairs.cube(*by).agg(*(c.alias(k) for k, c in all_metrics().items()))


def metrics_of_windows(pairs: DataFrame, *by: str) -> DataFrame:
    """rmse and mae over array columns y and yp without a row a step: sums of each window, then sums of those."""
    sq = F.aggregate(F.zip_with("y", "yp", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    ab = F.aggregate(F.zip_with("y", "yp", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    n = F.sum(F.size("y"))
    return pairs.groupBy(*by).agg(F.sqrt(F.sum(sq) / n).alias("rmse"), (F.sum(ab) / n).alias("mae"))


def nrmse_train_range(pairs: DataFrame, train: DataFrame, *by: str) -> DataFrame:
    """nrmse over the range of all training targets (one row, broadcast)."""
    span = train.agg((F.max("y") - F.min("y")).alias("span"))
    return pairs.crossJoin(F.broadcast(span)).groupBy(*by).agg(nrmse_of_range(F.col("y"), F.col("yp"), F.first("span")).alias("nrmse"))


def rmse_by_step(flat: DataFrame, *by: str) -> DataFrame:
    """rmse of every horizon step; flat: step, y, yp."""
    return flat.groupBy(*by, "step").agg(rmse(F.col("y"), F.col("yp")).alias("rmse"))


def metric_max(table: DataFrame, columns: tuple[str, ...] = ("rmse", "mae", "nrmse", "smape")) -> DataFrame:
    """The largest value of the metric columns."""
    return table.agg(F.greatest(*(F.max(c) for c in columns)).alias("max_value"))


def report(table: DataFrame) -> str:
    """A metric table as text, four decimals, one line a row; metric tables are a few rows."""
    columns = table.columns
    lines = ["  ".join(f"{c:>12}" for c in columns)]
    for r in table.orderBy(*(c for c in columns if c not in all_metrics())).collect():
        lines.append("  ".join(f"{v:>12.4f}" if isinstance(v, float) else f"{'-' if v is None else v:>12}" for v in r))
    return "\n".join(lines)
