"""Counting operators with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): how often each value occurs; null is no value."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with each value's share in percent of the non-null rows. The window sees a row per value."""
    total = F.sum("n").over(Window.partitionBy())
    return value_counts(rows, column).withColumn("share", F.round(100.0 * F.col("n") / total, 6))


def item_counts(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """(name, n) of lower-cased, trimmed list items, empty ones included."""
    return rows.select(F.explode(items).alias(name)).groupBy(F.lower(F.trim(name)).alias(name)).agg(F.count("*").alias("n"))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes each task's groups before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def top_and_others(rows: DataFrame, column: str, k: int, others: str = "Others") -> DataFrame:
    """(label, n): counts of the k most frequent values, and of all others together."""
    counts = value_counts(rows, column)
    top = counts.orderBy(F.desc("n"), column).limit(k).select(F.col(column).alias("_top"))
    label = F.when(F.col("_top").isNotNull(), F.col(column)).otherwise(others)
    return counts.join(top, F.col(column) == F.col("_top"), "left").groupBy(label.alias("label")).agg(F.sum("n").alias("n"))


def covering_items(counts: DataFrame, item: str, percent: float) -> DataFrame:
    """(item, n, place, share): the most frequent items that together reach ``percent`` of all.

    Counts are sorted in ranges of falling frequency; each range's sum is carried over to the ranges after it, so that
    no task sees all items.
    """
    ranged = counts.repartitionByRange(F.desc("n"), F.col(item)).withColumn("_range", F.spark_partition_id())
    before = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = before.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_places"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    along = Window.partitionBy("_range").orderBy(F.desc("n"), item)
    rows = ranged.join(before, "_range").withColumn("_upto", F.col("_before") + F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("place", (F.col("_places") + F.row_number().over(along)).cast("long"))
    kept = rows.filter(100.0 * (F.col("_upto") - F.col("n")) < percent * F.col("_total"))
    return kept.select(item, "n", "place", F.round(100.0 * F.col("_upto") / F.col("_total"), 6).alias("share"))
