"""Readers for the files that papers come in."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as line_ops

#: The columns of a harvested paper, as they are stored in CSV.
PAPER = (
    "title string, abstract string, authors string, figures double, pages double, tables double, pdf_link string, "
    "primary_subject string, secondary_subjects string, submitted_journal string, published_journal string, keywords string, date string"
)
#: The properties of a thesaurus entry that name it.
LABEL_PROPERTIES = ("prefLabel", "altLabel", "label")


def csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """CSV files (a path, a pattern or several) with quoted line breaks and doubled quotes, under a stated schema."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"', mode="PERMISSIVE")


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Harvested papers, typed: lists as arrays, counts as integers, dates as dates, blank text as null."""
    from ..functions.lists import parsed_list

    rows = csv(spark, path, PAPER)
    text = ["title", "abstract", "pdf_link", "primary_subject", "submitted_journal", "published_journal"]
    blank = {c: F.nullif(F.trim(c), F.lit("")) for c in text}
    lists = {c: parsed_list(F.col(c), "wrap") for c in ("authors", "secondary_subjects", "keywords")}
    return rows.withColumns(blank | lists | {c: F.col(c).cast("int") for c in ("figures", "pages", "tables")} | {"date": F.try_to_date("date")})


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file with an entry per line; blank lines and comments are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.filter("value <> '' AND NOT startswith(value, '#')")


def section_file(spark: SparkSession, path: str) -> DataFrame:
    """(title, body) of a file of ``PAPER:`` sections."""
    return line_ops.sections(spark.read.text(path, wholetext=True), "value")


def thesaurus_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label): the different literal names in a thesaurus, a JSON map of uri to property to values."""
    kind = "map<string, map<string, array<struct<type: string, value: string>>>>"
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("uri", "properties"))
    values = entries.select(F.explode("properties").alias("property", "values")).filter(F.regexp_extract("property", r"([^#/]+)$", 1).isin(*LABEL_PROPERTIES))
    return values.select(F.inline("values")).filter("type = 'literal'").select(F.col("value").alias("label")).distinct()


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, abstract, authors, published, categories) of the entries of Atom files."""
    schema = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(
        F.regexp_extract("id", r"(\d{4}\.\d{4,5})", 1).alias("id"),
        clean("title").alias("title"),
        clean("summary").alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        F.try_to_date(F.left("published", F.lit(10))).alias("published"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
    )


def range_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, first_item, last_item) of an XML manifest of archives."""
    schema = "filename string, first_item string, last_item string"
    return spark.read.format("xml").option("rowTag", "file").schema(schema).load(path)


def listing(pages: DataFrame, html: str) -> DataFrame:
    """A row per paper of listing pages: id, title, authors, comments, subjects, journal_ref, from its dt/dd pairs."""
    item = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<dt>.*?</dd>"), F.lit(0))).alias("_item")
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"^\s*\w[\w-]*:\s*", ""), r"\s+", " ")), F.lit(""))
    part = lambda name: F.regexp_extract("_item", rf'(?is)<div class=["\']list-{name}[^>]*>(.*?)</div>', 1)
    names = F.transform(F.regexp_extract_all(part("authors"), F.lit(r"(?is)<a [^>]*>(.*?)</a>"), F.lit(1)), lambda x: F.trim(x))
    return pages.select(item).select(
        F.regexp_extract("_item", r"(\d{4}\.\d{4,5})", 1).alias("id"), plain(part("title")).alias("title"), names.alias("authors"),
        plain(part("comments")).alias("comments"), plain(part("subjects")).alias("subjects"), plain(part("journal-ref")).alias("journal_ref"),
    )


def latex_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, latex): the .tex files of source archives, the largest first; an archive may be tar, tar.gz, gz or plain."""

    def unpack(content: bytes) -> str:
        try:
            content = gzip.decompress(content)
        except OSError:
            pass
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                files = [archive.extractfile(m).read() for m in archive if m.isfile() and m.name.endswith(".tex")]
        except tarfile.TarError:
            files = [content]
        return "\n".join(f.decode("utf-8", "replace") for f in sorted(files, key=len, reverse=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "latex": frame["content"].map(unpack)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, latex string")


def human_date(text):
    """A date such as "Monday, 6 January 2025" or "6 Jan 2025"; null for other text."""
    bare = F.regexp_replace(text, r"^\w+day,\s*", "")
    return F.coalesce(F.try_to_date(bare, "d MMMM yyyy"), F.try_to_date(bare, "d MMM yyyy"))


