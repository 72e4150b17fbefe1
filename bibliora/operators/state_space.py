"""ARIMA(1, 1, 1) forecasts of many series at once, by exact likelihood.

A series' differences are an ARMA(1, 1) process, written as a state of two numbers. A Kalman filter that starts from the
process's own distribution gives the exact likelihood of the differences, which is the diffuse likelihood of the series.
It is maximised over a grid of coefficients that is refined around the best; all points of a grid are filtered together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a grid in each direction, how often it is refined, and the largest coefficients that are tried.
POINTS, ROUNDS, LARGEST = 21, 7, 0.995


def filtered(changes: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of coefficients: the log-likelihood with the variance that is best, that variance, and the next change
    that the filter expects."""
    n = len(changes)
    # covariance of (change, ma * shock) in units of the shocks' variance
    p11, p12, p22 = (1 + 2 * ar * ma + ma**2) / (1 - ar**2), ma.copy(), ma**2
    a1, a2 = np.zeros_like(ar), np.zeros_like(ar)
    squares, logs = np.zeros_like(ar), np.zeros_like(ar)
    for change in changes:
        error, scale = change - a1, p11
        squares += error**2 / scale
        logs += np.log(scale)
        k1, k2 = (ar * p11 + p12) / scale, np.zeros_like(ar)
        a1, a2 = ar * a1 + a2 + k1 * error, k2 * error
        # what is known of the second part of the state: the shock of this step, as far as the change tells it
        p11, p12, p22 = ar**2 * p11 + 2 * ar * p12 + p22 + 1 - k1**2 * scale, ma, ma**2
    variance = np.maximum(squares / n, 1e-300)
    return -0.5 * (n * np.log(2 * np.pi * variance) + n + logs), variance, a1


def fit(values: np.ndarray) -> tuple[float, float, float, float]:
    """(ar, ma, variance, log-likelihood) of a series of at least three values."""
    changes, centre, reach = np.diff(np.asarray(values, float)), np.zeros(2), LARGEST
    for _ in range(ROUNDS):
        steps = np.linspace(-reach, reach, POINTS)
        ar, ma = (np.clip(g.ravel(), -LARGEST, LARGEST) for g in np.meshgrid(centre[0] + steps, centre[1] + steps, indexing="ij"))
        likelihood, variance, _ = filtered(changes, ar, ma)
        best = int(np.argmax(np.round(likelihood, 9)))
        centre = np.array([ar[best], ma[best]])
        reach *= 3 / (POINTS - 1)
    return float(centre[0]), float(centre[1]), float(variance[best]), float(likelihood[best])


def predicted(values: np.ndarray, steps: int) -> list[float]:
    """The next values of a series; one of fewer than three values, or without changes, stays at its last one."""
    values = np.asarray(values, float)
    if len(values) < 3 or not np.diff(values).any():
        return [float(values[-1])] * steps
    ar, ma, _, _ = fit(values)
    _, _, change = filtered(np.diff(values), np.array([ar]), np.array([ma]))
    found, last, step = [], float(values[-1]), float(change[0])
    for _ in range(steps):
        last += step
        found.append(last)
        step *= ar
    return found


def series_forecasts(rows: DataFrame, key: str, time: str, value: str, steps: int = 3) -> DataFrame:
    """(key, step, predicted) of each series, a key's values in order of time; null times and values are passed over.

    Rows of one key and time are added up first, so a task holds a series, a value for each time, and not its rows.
    """
    series = rows.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(key, time).agg(F.sum(F.col(value).cast("double")).alias("_value"))
    lists = series.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "_value"))), lambda x: x["_value"]).alias("_values"))

    @F.pandas_udf("array<double>")
    def ahead(lists: pd.Series) -> pd.Series:
        return pd.Series([predicted(values, steps) for values in lists])

    return lists.select(key, F.posexplode(ahead("_values")).alias("step", "predicted")).withColumn("step", F.col("step") + 1)
