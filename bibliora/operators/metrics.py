"""Bibliometric aggregates: conditional means, credit, coverage, calendar rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning


def citation_means(papers: DataFrame, key: str, citations: str, non_self: str | None, in_journal: Column) -> DataFrame:
    """By key: papers, mean citations (aac) and the same of journal papers (jac), and so for non-self citations
    (eaac, ejac), in one conditional aggregation. A null flag is no journal paper; null citations do not count."""
    found = [F.count("*").alias("n_papers"), F.avg(citations).alias("aac"), F.count_if(in_journal).alias("n_journal"), F.avg(F.when(in_journal, F.col(citations))).alias("jac")]
    if non_self:
        found += [F.avg(non_self).alias("eaac"), F.avg(F.when(in_journal, F.col(non_self))).alias("ejac")]
    return papers.groupBy(key).agg(*found)


def credit_by_item(rows: DataFrame, items: str, value: str, name: str) -> DataFrame:
    """(name, papers, total, per_paper): a row's whole value for each item of its list."""
    each = rows.select(F.explode(items).alias(name), F.col(value).alias("_value"))
    total = F.sum("_value")
    return each.groupBy(name).agg(F.count("*").alias("papers"), F.round(total, 4).alias("total"), F.round(total / F.count("*"), 6).alias("per_paper"))


def fractional_credit(rows: DataFrame, items: str, value: str, name: str) -> DataFrame:
    """(name, credit): a row's value in equal shares for the items of its list."""
    each = rows.select(F.explode(items).alias(name), (F.col(value) / F.size(items)).alias("_share"))
    return each.groupBy(name).agg(F.round(F.sum("_share"), 6).alias("credit"))


def slot_coverage(rows: DataFrame, slots: str) -> DataFrame:
    """Papers, papers with all slots known, with some, and unknown slots altogether."""
    unknown, size = cleaning.holes(F.col(slots)), F.size(slots)
    return rows.agg(
        F.count("*").alias("papers"),
        F.count_if(unknown == 0).alias("full_papers"),
        F.count_if((unknown > 0) & (unknown < size)).alias("partial_papers"),
        F.coalesce(F.sum(unknown), F.lit(0)).alias("null_slots"),
    )


def with_calendar(months: DataFrame, month: str) -> DataFrame:
    """Rows by month (its first day) with the month's days and business days."""
    last = F.last_day(month)
    weekdays = F.filter(F.sequence(F.col(month), last), lambda d: F.weekday(d) < 5)
    return months.withColumn("days", F.dayofmonth(last)).withColumn("business_days", F.size(weekdays))


def resampled_days(rows: DataFrame, time: str) -> DataFrame:
    """(day, n) for every day from the first to the last."""
    counts = rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def resampled(rows: DataFrame, time: str, unit: str) -> DataFrame:
    """(start, n): rows by calendar unit (``week`` from Monday, ``month``, ...), units without rows as 0."""
    counts = rows.filter(F.col(time).isNotNull()).groupBy(F.date_trunc(unit, time).cast("date").alias("start")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("start").alias("a"), F.max("start").alias("b")).filter("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("start"))
    return every.join(counts, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))
