"""Forecasts of short monthly series, one series per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _errors(change: np.ndarray, phi: float, theta: float) -> np.ndarray:
    found = np.zeros(len(change))
    for k in range(1, len(change)):
        found[k] = change[k] - phi * change[k - 1] - theta * found[k - 1]
    return found


def arima_111(values: np.ndarray, steps: int) -> np.ndarray:
    """An ARIMA(1, 1, 1) forecast: parameters by conditional least squares on a grid that is refined around its best."""
    change = np.diff(values.astype(float))
    if len(change) < 3 or not change.any():
        return np.full(steps, float(values[-1]) if len(values) else np.nan)
    center, reach = (0.0, 0.0), 0.95
    for _ in range(6):
        grid = [np.clip(np.linspace(c - reach, c + reach, 15), -0.99, 0.99) for c in center]
        center = min(((p, t) for p in grid[0] for t in grid[1]), key=lambda c: float((_errors(change, *c)[1:] ** 2).sum()))
        reach /= 5
    error, last, level, out = _errors(change, *center)[-1], change[-1], float(values[-1]), []
    for _ in range(steps):
        last = center[0] * last + center[1] * error
        error = 0.0
        level += last
        out.append(level)
    return np.array(out)


def forecast(rows: DataFrame, series: str, time: str, value: str, steps: int = 3) -> DataFrame:
    """(series, step, predicted): the next values of each series. A series is short (a row per month), so a group is."""
    kind = rows.schema[series].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(time)
        return pd.DataFrame({series: ordered[series].iloc[0], "step": range(1, steps + 1), "predicted": arima_111(ordered[value].to_numpy(), steps)})

    typed = rows.select(series, time, F.col(value).cast("double").alias(value)).dropna()
    return typed.groupBy(series).applyInPandas(run, f"`{series}` {kind}, step int, predicted double")
