import math

import pytest
from pyspark.sql import functions as F

from bibliora.functions import special
from bibliora.operators import inference


def evaluated(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_log_gamma(spark):
    values = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 33.0, 1e3, 1e6]
    for x, y in zip(values, evaluated(spark, [(v,) for v in values], "x double", special.log_gamma(F.col("x"))), strict=True):
        assert y == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)


def test_chi_square_probability(spark):
    cases = [(c, d) for d in (1, 2, 3, 5, 57, 400, 10_001) for c in (0.0, 1e-3, 0.5 * d, 0.97 * d, float(d), d + 1.99, d + 2.01, 1.3 * d, 3.0 * d)]
    found = evaluated(spark, cases, "c double, d int", special.chi2_probability(F.col("c"), F.col("d")))
    for (c, d), p in zip(cases, found, strict=True):
        assert p == pytest.approx(inference.chi2_p_value(c, d), abs=1e-9), (c, d)
        if d % 2 == 0 and c:  # the sum that even degrees of freedom have
            exact = math.fsum(math.exp(k * math.log(c / 2) - c / 2 - math.lgamma(k + 1)) for k in range(d // 2))
            assert p == pytest.approx(exact, rel=1e-9, abs=1e-14)
    assert evaluated(spark, [(1.0, 0)], "c double, d int", special.chi2_probability(F.col("c"), F.col("d"))) == [None]


def test_correlation_probability(spark):
    cases = [(r, n) for n in (2, 3, 4, 5, 12, 100, 2000) for r in (-1.0, -0.7, -0.05, 0.0, 1e-4, 0.02, 0.3, 0.95, 1.0)]
    found = evaluated(spark, cases, "r double, n int", special.correlation_probability(F.col("r"), F.col("n")))
    for (r, n), p in zip(cases, found, strict=True):
        assert p == pytest.approx(inference.correlation_p_value(r, n) if n > 2 else 1.0, abs=1e-9), (r, n)
    # two degrees of freedom have a closed form
    closed = evaluated(spark, [(0.3, 4)], "r double, n int", special.correlation_probability(F.col("r"), F.col("n")))[0]
    assert closed == pytest.approx(0.7, rel=1e-12)


def test_incomplete_beta_is_symmetric_and_monotonous(spark):
    cases = [(k / 20, a, b) for a in (0.5, 2.0, 30.0) for b in (0.5, 7.0) for k in range(21)]
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    found = evaluated(spark, cases, "x double, a double, b double", F.struct(special.incomplete_beta(x, a, b), special.incomplete_beta(1 - x, b, a)))
    assert all(p + q == pytest.approx(1, abs=1e-12) for p, q in found)
    for start in range(0, len(cases), 21):
        values = [p for p, _ in found[start : start + 21]]
        assert values[0] == 0 and values[-1] == 1 and values == sorted(values)
