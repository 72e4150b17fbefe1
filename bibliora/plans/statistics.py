"""Correlation, distribution tests, histograms, scaling and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as fn
from ..functions import special
from ..operators import inference as stat
from ..operators import state_space
from .registry import Tables, query


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_quantity, l_extendedprice) ** 2, 6) AS r2 FROM lineitem")
def pearson(t: Tables) -> DataFrame:
    r = F.corr("l_quantity", "l_extendedprice")
    return t.lineitem.agg(F.round(r, 6).alias("r"), F.round(r * r, 6).alias("r2"))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part)
            , c AS (SELECT corr(x, y) AS r, count(*) AS n FROM r)
       SELECT round(r, 6) AS rho, n,
              round(1 - list_sum(list_transform(range(0, 3000), lambda k: exp((k + 0.5) * ln(r * r) + (n - 2) / 2.0 * ln(1 - r * r) + lgamma((n - 1) / 2.0 + k) - lgamma(k + 1.5) - lgamma((n - 2) / 2.0)))), 6) AS p FROM c"""
)
def spearman(t: Tables) -> DataFrame:
    """Rank correlation: average ranks from counts of distinct values; p is the chance of one as far from 0."""
    found = stat.spearman(t.part, "p_size", "p_retailprice")
    return found.select(F.round("rho", 6).alias("rho"), "n", F.round(special.correlation_probability(F.col("rho"), F.col("n")), 6).alias("p"))


@query(
    """WITH v AS (SELECT o_totalprice AS x, o_orderstatus = 'F' AS a FROM orders),
            c AS (SELECT x, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM v GROUP BY x),
            s AS (SELECT sum(na) OVER w / sum(na) OVER () AS fa, sum(nb) OVER w / sum(nb) OVER () AS fb FROM c WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
       SELECT round(max(abs(fa - fb)), 9) AS d FROM s"""
)
def ks_two_sample(t: Tables) -> DataFrame:
    """The largest distance of two empirical distributions."""
    rows = t.orders.select("o_totalprice", (F.col("o_orderstatus") == "F").alias("a"))
    return stat.ks_distance(rows, "o_totalprice", F.col("a")).select(F.round("d", 9).alias("d"))


def _with_chance(found: DataFrame) -> DataFrame:
    """A chi-square value, its degrees of freedom, and the chance of one as large."""
    return found.select(F.round("chi2", 6).alias("chi2"), "dof", F.round(special.chi2_probability(F.col("chi2"), F.col("dof")), 6).alias("p"))


@query(
    """WITH b AS (SELECT floor(l_quantity / 10)::BIGINT AS bin, count(*) FILTER (l_returnflag = 'R') AS o, count(*) AS e FROM lineitem GROUP BY 1),
            s AS (SELECT o, e * (sum(o) OVER () / sum(e) OVER ()) AS e FROM b)
            , x AS (SELECT sum((o - e) ** 2 / e) AS chi2, count(*) - 1 AS dof FROM s WHERE e > 0)
       SELECT round(chi2, 6) AS chi2, dof, round(1 - list_sum(list_transform(range(0, 2000), lambda k: CASE WHEN chi2 > 0 THEN exp((dof / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + k + 1)) ELSE 0 END)), 6) AS p FROM x"""
)
def chi2_gof(t: Tables) -> DataFrame:
    """Goodness of fit of a subset's histogram to the whole's, scaled to the subset's size."""
    bins = t.lineitem.groupBy(F.floor(F.col("l_quantity") / 10).alias("bin")).agg(F.count_if(F.col("l_returnflag") == "R").alias("o"), F.count("*").alias("e"))
    return _with_chance(stat.chi2_fit(bins, "o", "e"))


@query(
    """WITH c AS (SELECT a.source, b.lang, count(d.doc_id) AS o FROM (SELECT DISTINCT source FROM documents) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b LEFT JOIN documents d ON d.source = a.source AND d.lang = b.lang GROUP BY 1, 2),
            e AS (SELECT o, sum(o) OVER (PARTITION BY source) * sum(o) OVER (PARTITION BY lang) / sum(o) OVER () AS e FROM c)
            , x AS (SELECT sum((o - e) ** 2 / e) AS chi2, ((SELECT count(DISTINCT source) FROM documents) - 1) * ((SELECT count(DISTINCT lang) FROM documents) - 1) AS dof FROM e)
       SELECT round(chi2, 6) AS chi2, dof, round(1 - list_sum(list_transform(range(0, 2000), lambda k: CASE WHEN chi2 > 0 THEN exp((dof / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + k + 1)) ELSE 0 END)), 6) AS p FROM x"""
)
def chi2_contingency(t: Tables) -> DataFrame:
    return _with_chance(stat.chi2_independence(t.documents, "source", "lang"))


@query("WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) SELECT doc_id, round((n_chars - m) / s, 6) AS sigma FROM documents, s WHERE abs(n_chars - m) > s")
def sigma_outliers(t: Tables) -> DataFrame:
    """Rows more than one standard deviation from the mean; the two scalars are a row of one aggregate."""
    return stat.with_sigma(t.documents.select("doc_id", "n_chars"), "n_chars").filter(F.abs("sigma") > 1).select("doc_id", F.round("sigma", 6).alias("sigma"))


@query("SELECT least(floor(n_chars / 500), 19)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 10000 GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    """Equal bins, the last one closed; values outside do not count."""
    bins = t.documents.select(fn.histogram_bin(F.col("n_chars"), 0, 10000, 20).alias("bin")).filter("bin IS NOT NULL")
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT least(floor(n_chars / 500), 19)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 10000 AND n_chars < 5000 GROUP BY 1")
def hist_filtered(t: Tables) -> DataFrame:
    rows = t.documents.filter("n_chars < 5000").select(fn.histogram_bin(F.col("n_chars"), 0, 10000, 20).alias("bin")).filter("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT floor((l_quantity - 1) / 10)::BIGINT AS q, floor(l_discount * 50)::BIGINT AS d, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.floor((F.col("l_quantity") - 1) / 10).alias("q"), F.floor(F.col("l_discount") * 50).alias("d")).agg(F.count("*").alias("n"))


@query("SELECT ceil(n_chars / 1000.0)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars > 0 AND n_chars <= 8000 GROUP BY 1")
def bin_right_closed(t: Tables) -> DataFrame:
    rows = t.documents.select(fn.right_closed_bin(F.col("n_chars"), 0, 8000, 1000).alias("bin")).filter("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT quantile_cont(s_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM supplier)
       SELECT s_suppkey, CASE WHEN s_acctbal <= q[1] THEN 0 WHEN s_acctbal <= q[2] THEN 1 WHEN s_acctbal <= q[3] THEN 2 WHEN s_acctbal <= q[4] THEN 3 ELSE 4 END AS class FROM supplier, q"""
)
def quantile_class(t: Tables) -> DataFrame:
    return stat.quantile_classes(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 5).select("s_suppkey", "class")


@query("WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (s_acctbal - lo) / (hi - lo) END, 6) AS scaled FROM supplier, m")
def minmax_scale(t: Tables) -> DataFrame:
    return stat.min_max_scaled(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT c_nationkey, round(least(1 + ln(1 + count(*)), 10), 6) AS weight FROM customer GROUP BY c_nationkey")
def log_weight(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.round(fn.log_weight(F.count("*"), 10), 6).alias("weight"))


@query(
    """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
       SELECT max(y)::INTEGER + 1 AS year, trunc(exp(regr_intercept(ln(n), y) + regr_slope(ln(n), y) * (max(y) + 1)))::BIGINT AS predicted FROM y"""
)
def growth_forecast(t: Tables) -> DataFrame:
    """The next year of a log-linear trend, cut to a whole number."""
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return stat.log_linear_forecast(years, "year", "n")


@query("SELECT l_orderkey, round(coalesce(sum(l_discount) / nullif(sum(l_tax), 0), 0), 6) AS ratio FROM lineitem GROUP BY l_orderkey")
def safe_ratio(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(fn.ratio(F.sum("l_discount"), F.sum("l_tax")), 6).alias("ratio"))


@query("SELECT round(100.0 * (count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'P')) / count(*), 6) AS share FROM orders")
def projected_share(t: Tables) -> DataFrame:
    """The share that published and submitted rows will make together."""
    return t.orders.agg(F.round(100.0 * (F.count_if(F.col("o_orderstatus") == "F") + F.count_if(F.col("o_orderstatus") == "P")) / F.count("*"), 6).alias("share"))


@query("SELECT event_type, round_even(avg(value), 2) AS mean FROM events GROUP BY event_type")
def round_half_even(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.bround(F.avg("value"), 2).alias("mean"))


@query("WITH s AS (SELECT avg(n) AS m, stddev_samp(n) AS s FROM (SELECT count(*) AS n FROM documents GROUP BY source)) SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), s WHERE abs(n - m) <= s")
def within_sigma(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return stat.with_sigma(counts, "n", keep_constant=True).filter(F.abs("sigma") <= 1).select("source", "n")


@query(
    """WITH v AS (SELECT p_retailprice AS x, p_size < 25 AS a FROM part),
            c AS (SELECT x, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM v GROUP BY x),
            s AS (SELECT sum(na) OVER w / sum(na) OVER () AS fa, sum(nb) OVER w / sum(nb) OVER () AS fb FROM c WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
            d AS (SELECT max(abs(fa - fb)) AS d, (SELECT sum(na)::DOUBLE FROM c) AS na, (SELECT sum(nb)::DOUBLE FROM c) AS nb FROM s),
            x AS (SELECT d, d * sqrt(na * nb / (na + nb)) AS x FROM d)
       SELECT round(d, 9) AS d, round(CASE WHEN x < 0.001 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))))) END, 6) AS p FROM x"""
)
def ks_probability(t: Tables) -> DataFrame:
    """The largest distance of two empirical distributions, and the chance of one as large."""
    rows = t.part.select("p_retailprice", (F.col("p_size") < 25).alias("a"))
    found = stat.ks_p_values(stat.ks_distance(rows, "p_retailprice", F.col("a")))
    return found.select(F.round("d", 9).alias("d"), F.round("p", 6).alias("p"))


@query()
def series_forecasts(t: Tables) -> DataFrame:
    """The next three days of every kind of event by ARIMA(1, 1, 1); SQL has no likelihood to maximise, so tests recompute it."""
    days = t.events.select("event_type", F.to_date("ts").alias("day"), F.lit(1).alias("n"))
    return state_space.series_forecasts(days, "event_type", "day", "n", 3).withColumn("predicted", F.round("predicted", 6))
