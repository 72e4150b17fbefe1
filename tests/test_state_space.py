import numpy as np
import pytest

from bibliora.operators import state_space
from bibliora.plans import catalog


def dense_likelihood(changes, ar, ma, variance):
    """The density of a normal vector with the autocovariances of an ARMA(1, 1) process."""
    n = len(changes)
    lags = np.empty(n)
    lags[0] = variance * (1 + 2 * ar * ma + ma**2) / (1 - ar**2)
    if n > 1:
        lags[1] = variance * (1 + ar * ma) * (ar + ma) / (1 - ar**2)
    for k in range(2, n):
        lags[k] = ar * lags[k - 1]
    matrix = lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    _, log = np.linalg.slogdet(matrix)
    return -0.5 * (n * np.log(2 * np.pi) + log + changes @ np.linalg.solve(matrix, changes)), matrix, lags


def simulated(rng, n, ar, ma):
    shocks = rng.normal(size=n + 200)
    changes = np.zeros(n + 200)
    for t in range(1, n + 200):
        changes[t] = ar * changes[t - 1] + shocks[t] + ma * shocks[t - 1]
    return np.cumsum(changes[200:]) + 50


@pytest.mark.parametrize(("ar", "ma"), [(0.0, 0.0), (0.6, 0.3), (-0.5, 0.8), (0.9, -0.7), (-0.95, -0.4)])
def test_filter_equals_the_dense_likelihood(ar, ma):
    rng = np.random.default_rng(int(10 * (ar + 2) + ma))
    changes = np.diff(simulated(rng, 40, ar, ma))
    for a, m in ((ar, ma), (0.2, -0.3), (-0.7, 0.9)):
        likelihood, variance, change = state_space.filtered(changes, np.array([a]), np.array([m]))
        dense, matrix, lags = dense_likelihood(changes, a, m, variance[0])
        assert likelihood[0] == pytest.approx(dense, rel=1e-9)
        # the expected next change, by regression on all changes before
        after = np.array([a ** (k - 1) * lags[1] for k in range(len(changes), 0, -1)])
        assert change[0] == pytest.approx(after @ np.linalg.solve(matrix, changes), rel=1e-7, abs=1e-9)


def test_fit_is_the_best_and_finds_the_process():
    values = simulated(np.random.default_rng(2), 600, 0.7, 0.4)
    ar, ma, variance, likelihood = state_space.fit(values)
    assert abs(ar - 0.7) < 0.1 and abs(ma - 0.4) < 0.12 and abs(variance - 1) < 0.15
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, m = rng.uniform(-0.99, 0.99, 2)
        assert state_space.filtered(np.diff(values), np.array([a]), np.array([m]))[0][0] <= likelihood + 1e-6


def test_series_by_key(spark):
    rng = np.random.default_rng(5)
    series = {"a": simulated(rng, 30, 0.5, 0.2), "b": simulated(rng, 24, -0.3, 0.1), "short": np.array([4.0, 6.0]), "flat": np.full(9, 2.0)}
    rows = [(k, t, float(v) / 2) for k, values in series.items() for t, v in enumerate(values) for _ in range(2)] + [("a", None, 1.0), ("b", 3, None), ("none", 1, None)]
    found = state_space.series_forecasts(spark.createDataFrame(rows, "k string, t int, v double").repartition(3), "k", "t", "v", 3).collect()
    assert {(r.k, r.step) for r in found} == {(k, s) for k in series for s in (1, 2, 3)}
    for k, values in series.items():
        assert [r.predicted for r in sorted((r for r in found if r.k == k), key=lambda r: r.step)] == pytest.approx(state_space.predicted(values, 3))
    assert state_space.predicted(series["flat"], 2) == [2.0, 2.0]


def test_query_over_the_events(spark):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").toPandas()
    counts = events.groupby(["event_type", events["ts"].dt.date]).size()
    found = {(r.event_type, r.step): r.predicted for r in catalog.QUERIES["series_forecasts"](spark, folder).collect()}
    expected = {(k, s): v for k, c in counts.groupby(level=0) for s, v in enumerate(state_space.predicted(c.sort_index().to_numpy(), 3), 1)}
    assert found == pytest.approx(expected, abs=1e-5)
