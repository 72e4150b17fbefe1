"""Streams of new rows: deduplication, tumbling counts, appends guarded by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import KeyedStore


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n) by tumbling windows of a day; rows later than the watermark do not count."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), kind, "n")


def first_of_each(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows without those whose key came before within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_new(spark: SparkSession, path: str, key: str):
    """A ``foreachBatch`` function that adds to a keyed store the rows whose key is not stored yet, once per key.

    A batch that failed halfway, or comes again, adds nothing twice; only buckets that it has keys of are read.
    """
    return KeyedStore(spark, path, [key], keep="first").sink()
