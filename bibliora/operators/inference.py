"""Statistics over columns, by aggregates over distinct values; p-values by series on the driver.

Distribution functions are sums over distinct values in order. They are built in ranges of the value, each with the
sums of the ranges before it, so no task sees all values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(counts: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """``counts`` (a row per value) with ``_upto_<c>``: the sum of c over this value and all smaller ones."""
    ranged = counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id())
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    before = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])
    along = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(before, "_range")
    return rows.select(*counts.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(along)).alias(f"_upto_{c}") for c in columns])


def one_row(totals: DataFrame) -> Column:
    """A table of one row as a struct that other plans can use: a scalar subquery."""
    return totals.select(F.struct(*totals.columns)).scalar()


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the average rank of each value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    return running_sums(counts, column, ["_n"]).select(column, (F.col("_upto__n") - (F.col("_n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n) of two columns over the rows that have both."""
    both = rows.select(x, y).dropna()
    ranked = both.join(average_ranks(both, x, "_rx"), x).join(average_ranks(both, y, "_ry"), y)
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def ks_distance(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """(d, na, nb): the two-sample Kolmogorov-Smirnov distance of the rows in the first sample and the others."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    sums = running_sums(counts, value, ["a", "b"])
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    rows = sums.withColumn("_t", one_row(totals))
    gap = F.abs(F.col("_upto_a") / F.col("_t.na") - F.col("_upto_b") / F.col("_t.nb"))
    return rows.agg(F.max(gap).alias("d"), F.max("_t.na").alias("na"), F.max("_t.nb").alias("nb"))


def chi2_fit(bins: DataFrame, observed: str, expected: str) -> DataFrame:
    """(chi2, dof) of observed counts against expected ones scaled to the same total; bins without expectation are left out."""
    totals = bins.agg(F.sum(observed).alias("_o"), F.sum(expected).alias("_e"))
    scaled = F.col(expected) * (F.col("_t._o") / F.col("_t._e"))
    rows = bins.withColumn("_t", one_row(totals)).filter(scaled > 0)
    return rows.agg(F.sum((F.col(observed) - scaled) ** 2 / scaled).alias("chi2"), (F.count("*") - 1).alias("dof"))


def chi2_independence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof) of a contingency table: sum of o^2/e over its non-empty cells, less the total."""
    cells = rows.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("o"))
    by_a, by_b = cells.groupBy(a).agg(F.sum("o").alias("_a")), cells.groupBy(b).agg(F.sum("o").alias("_b"))
    total = cells.agg(F.sum("o").alias("_n"))
    joined = cells.join(by_a, a).join(by_b, b).withColumn("_n", total.scalar())
    expected = F.col("_a") * F.col("_b") / F.col("_n")
    return joined.agg((F.sum(F.col("o") ** 2 / expected) - F.sum("o")).alias("chi2"), ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("dof"))


def with_sigma(rows: DataFrame, value: str, keep_constant: bool = False) -> DataFrame:
    """Rows with ``sigma``: the distance from the mean in sample standard deviations.

    Where all values are equal it is null, or 0 with ``keep_constant``.
    """
    scale = rows.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    sigma = F.try_divide(F.col(value) - F.col("_t._m"), F.col("_t._s"))
    sigma = F.when(F.col("_t._s") == 0, F.lit(0.0)).otherwise(sigma) if keep_constant else sigma
    return rows.withColumn("_t", one_row(scale)).withColumn("sigma", sigma).drop("_t")


def quantiles(rows: DataFrame, value: str, shares: list[float], name: str) -> DataFrame:
    """One row with an array: the exact quantiles of a column's values, interpolated between neighbours; null for none.

    They are read off running counts by value, so no task holds all values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    sums = running_sums(counts, value, ["_n"]).withColumn("_last", counts.agg((F.sum("_n") - 1).alias("_last")).scalar())
    found = []
    for share in shares:
        place = F.col("_last") * F.lit(share)
        at = lambda k: F.min(F.when(F.col("_upto__n") > k, F.col(value).cast("double")))
        part = F.max(place - F.floor(place))
        found.append(at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part)
    return sums.agg(F.array(*found).alias(name))


def quantile_classes(rows: DataFrame, value: str, classes: int) -> DataFrame:
    """Rows with ``class``: how many of the inner quantiles lie below the value."""
    cuts = quantiles(rows, value, [k / classes for k in range(1, classes)], "_cuts")
    return rows.withColumn("_cuts", cuts.scalar()).withColumn("class", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def min_max_scaled(rows: DataFrame, value: str) -> DataFrame:
    """Rows with ``scaled``: the value between the least (0) and the largest (1); 0.5 where they are equal."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_t._lo"), F.col("_t._hi") - F.col("_t._lo")), F.when(F.col(value).isNotNull(), 0.5))
    return rows.withColumn("_t", one_row(ends)).withColumn("scaled", scaled).drop("_t")


def log_linear_forecast(rows: DataFrame, time: str, value: str) -> DataFrame:
    """(time, predicted): the next value of a straight line through the logarithms, cut to a whole number."""
    log = F.log(F.col(value).cast("double"))
    fit = rows.agg(F.regr_slope(log, F.col(time)).alias("_b"), F.regr_intercept(log, F.col(time)).alias("_a"), F.max(time).alias("_t"))
    next_one = F.col("_t") + 1
    return fit.select(next_one.cast("int").alias(time), F.exp(F.col("_a") + F.col("_b") * next_one).cast("long").alias("predicted"))


def ks_p_value(d: float, na: int, nb: int) -> float:
    """The asymptotic probability of a two-sample distance of at least d."""
    x = d * math.sqrt(na * nb / (na + nb))
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def chi2_p_value(chi2: float, dof: int) -> float:
    """The probability of a chi-square value of at least chi2: the upper incomplete gamma function."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * scale


def correlation_p_value(r: float, n: int) -> float:
    """The two-sided probability of a correlation of at least |r| by chance, from Student's t by Simpson's rule."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    dof = n - 2
    t = abs(r) * math.sqrt(dof / (1 - r * r))
    steps, top = 4000, math.atan(t / math.sqrt(dof))
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    area = sum((1 if k in (0, steps) else 4 if k % 2 else 2) * math.cos(top * k / steps) ** (dof - 1) for k in range(steps + 1)) * top / steps / 3
    return min(1.0, max(0.0, 1 - 2 * scale * area))


def ks_p_values(distances: DataFrame) -> DataFrame:
    """Rows (d, na, nb, ...) with ``p``, the asymptotic probability of a distance of at least d: 100 terms of its series."""
    x = F.col("d") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.pow(x, F.lit(2.0)))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k))
    return distances.withColumn("p", F.when(x < 1e-3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total))))
