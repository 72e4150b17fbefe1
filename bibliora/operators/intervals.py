"""Joining keys of any ordered type with the intervals that hold them, without a width to cut them by.

The order is cut into ranges at points sampled from keys and ends of intervals. Within a range keys and intervals are
swept in order. An interval has to be compared only in the two ranges that its ends lie in; the ranges between them it
holds whole.

The first interval of each key: whole ranges are covered by nodes of a binary tree over the ranges, a few for each
interval, and of the intervals at a node only the first can count, so what the tree holds is as many rows as it has
nodes. Of the ends in a range only those count whose interval comes before the first one that holds the range whole; in
a range without such ends no key is swept. All intervals of each key: the interval goes into every range that it reaches, where each of its copies meets
every key, so copies beyond the two ends' are no more than matches.

Order is that of the type; strings compare by code point. Keys and ends that are null, and intervals that end before they
start, match nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a range is cut at are found among at most so many keys and ends; there are at most half as many ranges.
SAMPLE = 8192


def split_points(values: DataFrame, parts: int) -> list[Any]:
    """At most ``parts - 1`` values in order that cut a column of one name into parts of about equal numbers of different values.

    They are taken from a sample: the values with the smallest hashes, so reruns agree.
    """
    (name,) = values.columns
    sample = sorted(r[0] for r in values.dropna().distinct().orderBy(F.xxhash64(name), name).limit(SAMPLE).collect())
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def range_of(value: Column, points: list[Any], kind: str) -> Column:
    """How many of the points, which are in order, are not above a value: a binary search."""
    if not points:
        return F.lit(0)
    listed = F.array(*[F.lit(p) for p in points]).cast(f"array<{kind}>")

    def step(ends: Column, _: Column) -> Column:
        middle = ((ends["lo"] + ends["hi"]) / 2).cast("int")
        higher = F.get(listed, middle) <= value
        open_ = ends["lo"] < ends["hi"]
        return F.struct(F.when(open_ & higher, middle + 1).otherwise(ends["lo"]).alias("lo"), F.when(open_ & ~higher, middle).otherwise(ends["hi"]).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(points).bit_length())), ends, step)["lo"]


def covering_nodes(first: int, last: int) -> list[int]:
    """The nodes of the binary tree over ranges that cover the ranges from first to last and no other, few and disjoint.

    A node of level h that starts at range n * 2**h is numbered h * 2**24 + n.
    """
    found, level = [], 0
    end = last + 1
    while first < end:
        if first & 1:
            found.append(level << 24 | first)
            first += 1
        if end & 1:
            end -= 1
            found.append(level << 24 | end)
        first, end, level = first >> 1, end >> 1, level + 1
    return found


def _ranged(keys: DataFrame, key: str, intervals: DataFrame, low: str, high: str, parts: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Keys and intervals with the numbers of their ranges, and how many ranges there are."""
    spark, kind = keys.sparkSession, keys.schema[key].dataType.simpleString()
    parts = parts or max(2, min(SAMPLE // 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    given = intervals.filter(F.col(low) <= F.col(high))
    ends = given.select(F.explode(F.array(low, high)).alias("_value"))
    points = split_points(keys.select(F.col(key).alias("_value")).unionByName(ends), parts)
    ranged = given.withColumn("_first", range_of(F.col(low), points, kind)).withColumn("_last", range_of(F.col(high), points, kind))
    return keys.filter(F.col(key).isNotNull()).withColumn("_range", range_of(F.col(key), points, kind)), ranged, len(points) + 1


def _swept(keys: DataFrame, key: str, placed: DataFrame, low: str, high: str, order: str, every: bool) -> DataFrame:
    """(key, order) of keys and intervals of one range: the smallest order that holds a key, or each; none: null or no row."""
    kind, ranked = keys.schema[key].dataType.simpleString(), placed.schema[order].dataType.simpleString()
    starts = placed.select("_range", F.col(low).alias("_at"), F.lit(0).alias("_kind"), F.col(high).alias("_end"), F.col(order).alias("_order"))
    asked = keys.select("_range", F.col(key).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_end"), F.lit(None).cast(ranked).alias("_order"))
    events = starts.unionByName(asked).repartition("_range").sortWithinPartitions("_range", "_at", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, []
        for batch in batches:
            found_keys, found = [], []
            for number, at, what, end, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    current, open_ = number, []
                if not what:
                    heapq.heappush(open_, (end, rank) if every else (rank, end))
                elif every:
                    while open_ and open_[0][0] < at:
                        heapq.heappop(open_)
                    found_keys += [at] * len(open_)
                    found += [r for _, r in open_]
                else:
                    while open_ and open_[0][1] is not None and open_[0][1] < at:
                        heapq.heappop(open_)
                    found_keys.append(at)
                    found.append(open_[0][0] if open_ else None)
            types = batch.schema.field(1).type, batch.schema.field(4).type
            yield pa.RecordBatch.from_arrays([pa.array(found_keys, types[0]), pa.array(found, types[1])], names=["key", "order"])

    return events.mapInArrow(run, f"key {kind}, order {ranked}").toDF(key, order)


def first_intervals(keys: DataFrame, key: str, intervals: DataFrame, low: str, high: str, order: str, parts: int | None = None) -> DataFrame:
    """(key, order): each different key with the smallest ``order`` among the intervals [low, high] that hold it, if any does.

    ``order`` tells intervals apart and ranks them.
    """
    ranged, given, many = _ranged(keys.select(key).distinct(), key, intervals.select(low, high, order), low, high, parts)
    ranked = given.schema[order].dataType.simpleString()
    nodes = F.udf(covering_nodes, "array<int>", useArrow=False)
    whole = given.filter("_last - _first > 1").groupBy("_first", "_last").agg(F.min(order).alias(order))
    tree = whole.select(order, F.explode(nodes(F.col("_first") + 1, F.col("_last") - 1)).alias("_node")).groupBy("_node").agg(F.min(order).alias(order))
    levels = F.array(*[F.shiftright(F.col("_range"), h).bitwiseOR(F.lit(h << 24)) for h in range(many.bit_length() + 1)])
    ranges = keys.sparkSession.range(many).select(F.col("id").cast("int").alias("_range"))  # at most SAMPLE / 2 rows
    above = ranges.select("_range", F.explode(levels).alias("_node")).join(tree, "_node").groupBy("_range").agg(F.min(order).alias("_whole"))
    # an end counts only where the interval comes before the first one that holds the range whole
    ends = given.select(low, high, order, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_range"), "_first")
    counted = ends.join(F.broadcast(above), "_range", "left").filter(F.col("_whole").isNull() | (F.col(order) < F.col("_whole")))
    swept_in = counted.select("_range").distinct()
    # a null start: open from the start of the range on, before every key there; a null end: to its end
    start = F.when(F.col("_range") <= F.col("_first"), F.col(low))
    behind = above.join(F.broadcast(swept_in), "_range", "left_semi").select("_range", F.lit(None).cast(given.schema[low].dataType).alias(low), F.lit(None).cast(given.schema[high].dataType).alias(high), F.col("_whole").alias(order))
    placed = counted.select("_range", start.alias(low), high, order).unionByName(behind)
    swept = _swept(ranged.join(F.broadcast(swept_in), "_range", "left_semi"), key, placed, low, high, order, every=False)
    held = ranged.join(F.broadcast(above), "_range").join(F.broadcast(swept_in), "_range", "left_anti").select(key, F.col("_whole").alias(order))
    return swept.filter(F.col(order).isNotNull()).unionByName(held.select(key, F.col(order).cast(ranked).alias(order)))


def all_intervals(keys: DataFrame, key: str, intervals: DataFrame, low: str, high: str, order: str, parts: int | None = None) -> DataFrame:
    """(key, order): each different key with every interval [low, high] that holds it."""
    ranged, given, _ = _ranged(keys.select(key).distinct(), key, intervals.select(low, high, order), low, high, parts)
    least = ranged.groupBy("_range").agg(F.min(key).alias("_least"))  # ranges without a key need no copy
    spread = given.withColumn("_range", F.explode(F.sequence("_first", "_last"))).join(least, "_range")
    start = F.when(F.col("_range") > F.col("_first"), F.least("_least", low)).otherwise(F.col(low))
    return _swept(ranged, key, spread.select("_range", start.alias(low), high, order), low, high, order, every=True)
