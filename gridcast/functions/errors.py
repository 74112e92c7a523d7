"""Forecast-error metrics as aggregate expressions, computed from sums in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPSILON


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def nrmse(y: Column, p: Column) -> Column:
    """RMSE over the range of the evaluated truth; null where that is constant."""
    return F.try_divide(rmse(y, p), F.max(y) - F.min(y))


def nrmse_of_range(y: Column, p: Column, span: Column) -> Column:
    """RMSE over a given range, such as that of the training targets."""
    return rmse(y, p) / F.greatest(span, F.lit(EPSILON))


def smape(y: Column, p: Column) -> Column:
    """100 times the mean of |y - p| over |y| + |p|: between 0 and 100."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(EPSILON))) * 100


def all_metrics(y: str = "y", p: str = "yp") -> dict[str, Column]:
    y, p = F.col(y), F.col(p)
    return {"rmse": rmse(y, p), "mae": mae(y, p), "nrmse": nrmse(y, p), "smape": smape(y, p)}
