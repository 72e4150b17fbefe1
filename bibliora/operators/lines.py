"""Lines of texts: explosion with positions, cuts at gaps, windows around a keyword, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of every line, from 1."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def until_gap(rows: DataFrame, key: str, pos: str, hit: Column, gap: int) -> DataFrame:
    """Rows with a hit before the first gap of at least ``gap`` rows without one, counted from the first hit."""
    along = Window.partitionBy(key).orderBy(pos)
    hits = rows.filter(hit).withColumn("_far", F.coalesce(F.col(pos) - F.lag(pos).over(along) > gap, F.lit(False)).cast("int"))
    return hits.withColumn("_cut", F.max("_far").over(along)).filter("_cut = 0").drop("_far", "_cut")


def around_first(rows: DataFrame, text: str, keyword: str, reach: int) -> DataFrame:
    """Rows with ``lines``: those within ``reach`` of the first line that contains the keyword, null if none does."""
    parts = F.split(text, "\n")
    first = F.array_position(F.transform(parts, lambda x: x.contains(keyword)), True)
    start = F.greatest(first - reach, F.lit(1))
    return rows.withColumn("lines", F.when(first > 0, F.slice(parts, start.cast("int"), (first + reach - start + 1).cast("int"))))


def sections(rows: DataFrame, text: str) -> DataFrame:
    """(title, body) of the sections of wholetext rows: ``PAPER: <title>`` up to the next, rulers of dashes left out."""
    part = F.explode(F.split(text, "(?=PAPER:)")).alias("_section")
    title = F.trim(F.regexp_extract("_section", r"PAPER:\s*([^\n]+)", 1))
    body = F.regexp_replace(F.regexp_replace("_section", r"^PAPER:[^\n]*\n?", ""), r"(?m)^-{70,}\s*$\n?", "")
    found = rows.select(part).select(F.nullif(title, F.lit("")).alias("title"), F.trim(F.regexp_replace(body, r"(?m)^AFFILIATION SECTION:\s*", "")).alias("body"))
    return found.withColumn("body", F.btrim("body", F.lit(" \n\t"))).filter("title IS NOT NULL")


def from_first(text: Column, pattern: str, most: int, otherwise: int) -> Column:
    """The first line that matches a pattern and up to ``most`` lines after it; without one the first ``otherwise`` characters."""
    parts = F.split(text, "\n")
    first = F.array_position(F.transform(parts, lambda x: x.rlike(pattern)), True)
    return F.when(first > 0, F.array_join(F.slice(parts, first.cast("int"), F.lit(most + 1)), "\n")).otherwise(F.left(text, F.lit(otherwise)))


def ruled_sections(text: Column, least: int = 70) -> Column:
    """The parts of a text between rulers, lines of at least ``least`` dashes; trimmed, and those left empty dropped."""
    return F.filter(F.transform(F.split(text, rf"(?m)^-{{{least},}}[ \t]*$"), lambda x: F.btrim(x, F.lit(" \n\t"))), lambda x: x != "")
