"""Joins by position in a text: for each mark the nearest other mark, or all within reach.

Marks of a text are one ordered stream: each carries the last mark of the other kind forward and the next one backward. As
nothing is carried beyond the reach, a text is cut into stretches of a few reaches, and marks near a border go into both
stretches; so a text of very many marks is shared by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches have so many times the reach.
STRETCH = 16
#: What ends the front matter of a paper's text, and how an institution's address is recognised in it.
FRONT_ENDS = ("Abstract", "Introduction", "Keywords", "I.", "1.", "Methods")
_PLACE = r"(?:University|Institute|Laboratory|School|Center|Centre)"
ADDRESS = rf"(?i)(?:Department|{_PLACE})[^.]*(?:[^.]*{_PLACE}[^.]*)*\."
ADDRESS_LEAST, NAME_REACH = 20, 250
MARKED_ADDRESS = r"(?:^|\s)(\d{1,3}|[*†‡§¶])\s*((?:Department|Dept|Faculty|School|Institute|University|Observatory|Laboratory|Cent(?:er|re))\b[^.]*\.)"
NAME_MARKS = r"\s*((?:\d{1,3}|[*†‡§¶])(?:\s*,\s*(?:\d{1,3}|[*†‡§¶]))*)"


def spans(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, start, end, found, parts) of every match of a pattern in a text, by characters from 0; parts are its groups."""
    compiled, kind = re.compile(pattern), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, end, found, parts = [], [], [], [], []
            for n, content in enumerate(batch.column(1)):
                for m in compiled.finditer(content.as_py() or ""):
                    at.append(n)
                    start.append(m.start())
                    end.append(m.end())
                    found.append(m[0])
                    parts.append(list(m.groups()))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.string()), pa.array(parts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "end", "found", "parts"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, start int, end int, found string, parts array<string>")


def nearest(marks: DataFrame, others: DataFrame, key: str, at: str, value: str, reach: int) -> DataFrame:
    """Rows of ``marks`` with ``value`` and ``distance`` of the nearest row of ``others`` in the same text, at most ``reach``
    away; the earlier of two as near. Both are null where none is. Of others at one place the smallest value counts."""
    size = reach * STRETCH
    stretch = lambda c: F.floor(c / size).cast("long")
    right = others.groupBy(key, at).agg(F.min(value).alias("_value")).withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col(at) - reach), stretch(F.col(at) + reach)))))
    stream = marks.select("*", stretch(F.col(at)).alias("_stretch"), F.lit(None).cast(dict(others.dtypes)[value]).alias("_value"), F.lit(True).alias("_mark"))
    stream = stream.unionByName(right.withColumn("_mark", F.lit(False)), allowMissingColumns=True).withColumn("_other", F.when(~F.col("_mark"), F.struct(F.col(at).alias("at"), F.col("_value").alias("value"))))
    along = Window.partitionBy(key, "_stretch").orderBy(at, "_mark")  # others before marks of one place
    before = F.last("_other", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_other", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    found = stream.withColumn("_before", before).withColumn("_after", after).filter("_mark")
    left, right_gap = F.col(at) - F.col("_before.at"), F.col("_after.at") - F.col(at)
    best = F.when(left <= F.least(F.coalesce(right_gap, left), F.lit(reach)), F.struct(left.alias("distance"), F.col("_before.value").alias("value"))).when(
        right_gap <= reach, F.struct(right_gap.alias("distance"), F.col("_after.value").alias("value"))
    )
    return found.withColumn("_best", best).select(*marks.columns, F.col("_best.value").alias(value), F.col("_best.distance").cast("int").alias("distance"))


def within(marks: DataFrame, others: DataFrame, key: str, at: str, start: str, end: str, reach: int) -> DataFrame:
    """Pairs of rows of ``marks`` and of ``others`` in the same text that lie wholly within ``reach`` of the mark."""
    size = reach * STRETCH
    stretch = lambda c: F.floor(c / size).cast("long")
    right = others.filter(F.col(end) - F.col(start) <= 2 * reach).withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col(end) - reach), stretch(F.col(start) + reach)))))
    near = marks.withColumn("_stretch", stretch(F.col(at))).join(right, [key, "_stretch"])
    return near.filter((F.col(start) >= F.col(at) - reach) & (F.col(end) <= F.col(at) + reach)).drop("_stretch")


def front_text(text: Column) -> Column:
    """A text with single blanks, up to the first of each phrase that ends a paper's front matter, one after another."""
    cut = F.regexp_replace(text, r"\s+", " ")
    for phrase in FRONT_ENDS:
        cut = F.substring_index(cut, phrase, 1)
    return cut


def _authors(papers: DataFrame, key: str, authors: str) -> DataFrame:
    return papers.select(key, "_text", F.posexplode(authors).alias("place", "author"))


def affiliations_by_nearness(papers: DataFrame, key: str, text: str, authors: str) -> DataFrame:
    """(key, place, author, affiliations): addresses in the front matter wholly within NAME_REACH characters of where the
    author's name first stands, each once, in order; null where the name or an address is missing."""
    rows = papers.withColumn("_text", front_text(F.col(text)))
    addresses = spans(rows, key, "_text", ADDRESS).withColumn("found", F.trim("found")).filter(F.length("found") > ADDRESS_LEAST).select(key, "start", "end", "found")
    named = _authors(rows, key, authors).withColumn("at", F.instr("_text", F.col("author")) - 1).drop("_text")
    near = within(named.filter("at >= 0"), addresses, key, "at", "start", "end", NAME_REACH)
    lists = near.groupBy(key, "place").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "found"))), lambda x: x["found"])).alias("affiliations"))
    return named.drop("at").join(lists, [key, "place"], "left")


def affiliations_by_marks(papers: DataFrame, key: str, text: str, authors: str) -> DataFrame:
    """(key, place, author, affiliations): addresses whose mark, a number or sign before them, stands behind the author's name;
    of addresses with one mark the first after the name, or else the last before it. Null where a mark leads nowhere."""
    rows = papers.withColumn("_text", F.regexp_replace(text, r"\s+", " "))
    defined = spans(rows, key, "_text", MARKED_ADDRESS).select(key, F.col("parts")[0].alias("mark"), "start", F.trim(F.col("parts")[1]).alias("found"))
    named = _authors(rows, key, authors).withColumn("at", F.instr("_text", F.col("author")) - 1)
    behind = F.regexp_extract(F.substr("_text", F.col("at") + F.length("author") + 1, F.lit(60)), f"^{NAME_MARKS}", 1)
    marked = named.filter("at >= 0").select(key, "place", "at", F.posexplode(F.regexp_extract_all(behind, F.lit(r"\d{1,3}|[*†‡§¶]"), F.lit(0))).alias("n", "mark"))
    nearest_one = F.min_by("found", F.struct(F.col("start") < F.col("at"), F.abs(F.col("start") - F.col("at"))))
    tied = marked.join(defined, [key, "mark"]).groupBy(key, "place", "n").agg(nearest_one.alias("found"))
    lists = tied.groupBy(key, "place").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "found"))), lambda x: x["found"])).alias("affiliations"))
    return named.drop("at", "_text").join(lists, [key, "place"], "left")
