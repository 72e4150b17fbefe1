"""Special functions as column expressions: sums and continued fractions in ``aggregate``, nothing outside the JVM.

The number of terms follows from the arguments: a fixed part and a part that grows with the square root of the largest,
as convergence does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series or a fraction: so many, and so many times the root of the largest argument, and never more than the last.
TERMS, TERMS_BY_ROOT, MOST_TERMS = 60, 12, 100_000
#: Coefficients of Stirling's series, Bernoulli numbers over k (k - 1).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_SHIFT = 10


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0, by Stirling's series at x + 10."""
    far = x + F.lit(float(_SHIFT))
    series = sum((F.lit(c) / F.pow(far, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    between = sum((F.ln(x + F.lit(float(k))) for k in range(_SHIFT)), F.lit(0.0))
    return (far - 0.5) * F.ln(far) - far + 0.5 * math.log(2 * math.pi) + series - between


def _terms(*arguments: Column) -> Column:
    largest = F.greatest(*arguments, F.lit(0.0)) if len(arguments) > 1 else arguments[0]
    return F.least(F.lit(MOST_TERMS), (F.lit(TERMS) + TERMS_BY_ROOT * F.sqrt(largest)).cast("int"))


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), for a > 0 and x >= 0."""
    scale = F.exp(a * F.ln(x) - x - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x / (a + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    lower = scale * F.aggregate(F.sequence(F.lit(1), _terms(a, x)), start, add)["total"]
    # k (a - k) / (x + 2 k + 1 - a + ...), from its far end
    rest = F.aggregate(F.reverse(F.sequence(F.lit(1), _terms(a, x))), F.lit(0.0), lambda f, k: k * (a - k) / (x + 2 * k + 1 - a + f))
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lower).otherwise(scale / (x + 1 - a + rest))


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    scale = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a

    def step(f: Column, m: Column) -> Column:
        # two terms of the fraction, the later one first
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + f))

    rest = F.aggregate(F.reverse(F.sequence(F.lit(1), _terms(a, b))), F.lit(0.0), step)
    first = -(a + b) * x / (a + 1)
    return scale / (1 + first / (1 + rest))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I(x; a, b), for a and b > 0 and x from 0 to 1."""
    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(near, _beta_fraction(x, a, b)).otherwise(1 - _beta_fraction(1 - x, b, a))


def chi2_probability(chi2: Column, dof: Column) -> Column:
    """The chance of a chi-square value of at least ``chi2``; null without degrees of freedom."""
    half = dof.cast("double") / 2
    return F.when(dof > 0, upper_gamma(half, chi2 / 2))


def correlation_probability(r: Column, n: Column) -> Column:
    """The two-sided chance of a correlation of at least \\|r\\| among n independent pairs, by Student's t; 1 for fewer than three."""
    free = (n - 2).cast("double") / 2
    return F.when(n < 3, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(incomplete_beta(1 - r * r, free, F.lit(0.5)))
