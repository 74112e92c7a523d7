"""Seasonal ARIMA forecasts of many series, one task a series.

Fitted by two regressions (Hannan and Rissanen): a long autoregression gives residuals, and the differenced series is
regressed on its own and the residuals' lags. Seasonal and ordinary lags multiply out, each product with a coefficient
of its own; neither stationarity nor invertibility is enforced. Both regressions run over the whole series, block by
block: what a task holds of a series are its values, and one block of the design.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


#: Rows of a design that are held at once.
BLOCK = 16_384


@dataclass(frozen=True)
class Order:
    """(p, d, q) and (P, D, Q, season)."""

    order: tuple[int, int, int] = (1, 0, 0)
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)

    def lags(self, part: int) -> list[int]:
        """Lags of the autoregressive (0) or moving-average (2) part."""
        season = self.seasonal[3]
        steps = {i + season * k for i in range(self.order[part] + 1) for k in range(self.seasonal[part] + 1)}
        return sorted(steps - {0})


def difference(x: np.ndarray, order: Order) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The differenced series, and what undoes each step: its lag and the values before."""
    undo = []
    for lag in [order.seasonal[3]] * order.seasonal[1] + [1] * order.order[1]:
        undo.append((lag, x.copy()))
        x = x[lag:] - x[:-lag]
    return x, undo


def _designs(parts: list[tuple[np.ndarray, list[int]]], start: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of the rows from start on: a constant and, of every series of parts, its lags."""
    size = len(parts[0][0])
    for s in range(start, size, BLOCK):
        e = min(s + BLOCK, size)
        yield slice(s, e), np.column_stack([np.ones(e - s), *(x[s - k : e - k] for x, lags in parts for k in lags)])


def _regression(z: np.ndarray, parts: list[tuple[np.ndarray, list[int]]], start: int) -> np.ndarray:
    """Least squares of z on the designs: the triangular factor of all blocks stands for all rows."""
    kept = np.zeros((0, 2 + sum(len(lags) for _, lags in parts)))
    for rows, design in _designs(parts, start):
        kept = np.linalg.qr(np.vstack([kept, np.column_stack([design, z[rows]])]), mode="r")
    return np.linalg.lstsq(kept[:, :-1], kept[:, -1], rcond=np.finfo(float).eps * max(len(z) - start, kept.shape[1] - 1))[0]


def _residuals(z: np.ndarray, parts: list[tuple[np.ndarray, list[int]]], start: int, coefficients: np.ndarray) -> np.ndarray:
    out = np.empty(len(z) - start)
    for rows, design in _designs(parts, start):
        out[rows.start - start : rows.stop - start] = z[rows] - design @ coefficients
    return out


def forecast(x: np.ndarray, order: Order, steps: int) -> np.ndarray:
    """The next steps values; the last value, or 0, where the series is too short to fit."""
    z, undo = difference(np.asarray(x, dtype=float), order)
    ar, ma = order.lags(0), order.lags(2)
    start = max([*ar, *ma, 1])
    long = min(len(z) // 4, start + 10)
    if len(z) - start - long < 2 * (len(ar) + len(ma) + 1):
        return np.full(steps, float(x[-1]) if len(x) else 0.0)
    residual = np.zeros(len(z))
    if ma:
        before = [(z, list(range(1, long + 1)))]
        residual[long:] = _residuals(z, before, long, _regression(z, before, long))
        start = max(start, long + max(ma))
    parts = [(z, ar), (residual, ma)]
    coefficients = _regression(z, parts, start)
    if ma:
        residual[start:] = _residuals(z, parts, start, coefficients)
    z, residual = list(z), list(residual)
    for _ in range(steps):
        row = [1.0, *(z[-k] for k in ar), *(residual[-k] for k in ma)]
        z.append(float(np.dot(coefficients, row)))
        residual.append(0.0)
    out = z[-steps:]
    for lag, before in reversed(undo):
        values = list(before)
        for v in out:
            values.append(v + values[-lag])
        out = values[-steps:]
    return np.array(out)


def forecast_series(series: DataFrame, order: Order, steps: int, key: str = "i", value: str = "y") -> DataFrame:
    """key, step, yp for every entity, fitted to its whole series."""
    ship(series.sparkSession)
    rows = series.select(key, "pos", value)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        out = forecast(df[value].to_numpy(), order, steps)
        return pd.DataFrame({key: df[key].iloc[0], "step": np.arange(steps, dtype="int32"), "yp": out})

    return rows.groupBy(key).applyInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, step int, yp double")
