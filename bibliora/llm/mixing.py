"""Mixing sources to target weights with hash-threshold histograms.

Every document has a pseudo-random 60-bit position, a hash of its id. A source that is to give ``target`` of its
``size`` words repeats all its documents ``floor(target / size)`` times, and once more those whose position lies
below a threshold. The threshold comes from nested histograms: words by source and leading 15 bits, then only the
boundary bucket by its next 15 bits, and so on. Documents are filtered, never sorted.

Defined results: null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own;
rows with the same doc_id have the same position and are taken together; an empty table gives an empty result;
extra columns of any name but ``__copies`` and ``__copy`` pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import saved

BITS, LEVELS = 15, 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(doc_id: Column) -> Column:
    """A document's pseudo-random place in [0, 2**60): the leading 15 hex digits of the MD5 of its id."""
    digits = F.substring(F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) with a column target: words that each source is to give.

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes. No target
    exceeds ``most`` times its source's size; the excess goes to the others by weight. So target is
    min(weight * L, most * size) for one level L. With sources ordered by where they are full, most * size / weight,
    L is what the full ones leave divided by the weights of the rest. The windows see a row per source.
    """
    levels = Window.orderBy("_full_at", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    level = F.first("_level").over(Window.orderBy(F.col("_level") >= F.col("_full_at"), "_full_at", "_rank"))
    return (
        by_source.withColumn("_rank", rank)
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_most", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_full_at", F.col("_most") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("_full", F.coalesce(F.sum("_most").over(levels.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(levels.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
        .select("source", "source_size", F.least("_most", F.col("_weight") * level).alias("target"))
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with columns whole (copies of all documents), below (one more for positions below) and more.

    ``more`` tells whether the documents at the threshold itself are taken as well, which is so if that comes nearer
    to the target. Each level sums the words of the boundary bucket of the level above only.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = saved(
        goals.withColumn("whole", whole).select(
            "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("_need"), F.lit(0).cast("long").alias("_prefix")
        ),
        "mixing-edge",
    )
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("_position", shift)
        inside = sized.select("source", "_size", bucket.alias("_bucket"), F.shiftright("_position", shift + BITS).alias("_outer"))
        histogram = (
            inside.alias("d")
            .join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("_outer") == F.col("_prefix")) & (F.col("_need") > 0))
            .groupBy("d.source", "_bucket")
            .agg(F.sum("_size").alias("_words"))
        )
        along = Window.partitionBy("source").orderBy("_bucket")
        reached = F.sum("_words").over(along)
        boundary = (
            histogram.withColumn("_reached", reached)
            .alias("h")
            .join(edge.alias("e"), F.col("h.source").eqNullSafe(F.col("e.source")) & (F.col("_reached") >= F.col("_need")))
            .groupBy("e.source")
            .agg(F.min_by(F.struct("_bucket", "_words", (F.col("_need") - F.col("_reached") + F.col("_words")).alias("_left")), "_bucket").alias("_b"))
        )
        edge = saved(
            edge.alias("e")
            .join(boundary.alias("b"), F.col("e.source").eqNullSafe(F.col("b.source")), "left")
            .select(
                "e.source", "source_size", "target", "whole",
                # without a boundary nothing more is needed, and nothing lies below the threshold
                F.coalesce("_b._left", F.lit(0.0)).alias("_need"),
                F.coalesce("_b._bucket", F.col("_prefix") * (1 << BITS)).alias("_prefix"),
                F.coalesce("_b._words", F.lit(0)).cast("double").alias("_here"),
            ),
            "mixing-edge",
        )
    return edge.select("source", "source_size", "target", "whole", F.col("_prefix").alias("below"), (2 * F.col("_need") > F.col("_here")).alias("more"))


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """How often each document is taken: (doc_id, source, _size, _copies, source_size, target), and the sources' thresholds."""
    sized = saved(documents.select("doc_id", "source", word_count(F.col("text")).alias("_size"), position(F.col("doc_id")).alias("_position")), "mixing-sizes")
    goals = source_targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    cuts = thresholds(sized, goals)
    once_more = (F.col("_position") < F.col("below")) | ((F.col("_position") == F.col("below")) & F.col("more"))
    taken = (
        sized.alias("d")
        .join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")), "left")
        .select("doc_id", "d.source", "_size", (F.col("whole") + once_more.cast("long")).alias("_copies"), "source_size", "target")
    )
    return taken, cuts


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as it is taken; those taken no time are absent.

    Documents of no words have no part in the budget and follow the same threshold.
    """
    _, cuts = mix_sources(documents, weights, most)
    place = position(F.col("d.doc_id"))
    copies = F.col("c.whole") + ((place < F.col("c.below")) | ((place == F.col("c.below")) & F.col("c.more"))).cast("long")
    rows = documents.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select("d.*", copies.alias("__copies"))
    return rows.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__copies", "__copy")
