"""Answers, rendered pages and titles: what has no built-in goes through Arrow UDFs, the rest stays in the JVM."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: The form of a batch answer: papers with authors, their affiliations and countries.
BATCH = "struct<papers: array<struct<arxiv_id: string, authors: array<struct<name: string, affiliations: array<string>, countries: array<string>>>, first_author_countries: array<string>>>>"
RENDERED = ArrayType(StructType([StructField("author", StringType()), StructField("affiliations", ArrayType(StringType()))]))
_BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """JSON text with invalid escapes and bare line breaks inside its strings made valid; null if it stays invalid."""

    def repair(text: str | None) -> str | None:
        if text is None:
            return None
        for attempt in (text, _STRING.sub(lambda m: _BAD_ESCAPE.sub(r"\\\\", m[0]).replace("\n", "\\n").replace("\t", "\\t"), text)):
            try:
                return json.dumps(json.loads(attempt), ensure_ascii=False)
            except ValueError:
                continue
        return None

    return texts.map(repair)


def batch_papers(answer: Column) -> Column:
    """The papers of a batch answer, whatever stands around the JSON; missing lists are empty, papers without an id go."""
    inner = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    papers = F.from_json(repaired_json(inner), BATCH)["papers"]
    none = F.array().cast("array<string>")
    author = lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["affiliations"], none).alias("affiliations"), F.coalesce(a["countries"], none).alias("countries"))
    whole = F.transform(papers, lambda p: F.struct(p["arxiv_id"].alias("arxiv_id"), F.transform(F.coalesce(p["authors"], F.array()), author).alias("authors"), F.coalesce(p["first_author_countries"], none).alias("first_author_countries")))
    return F.coalesce(F.filter(whole, lambda p: p["arxiv_id"].isNotNull()), F.array())


def paper_columns(paper: str) -> list[Column]:
    """Columns of a paper struct for CSV: lists as JSON, an author's lists joined by semicolons."""
    authors = F.col(f"{paper}.authors")
    joined = lambda field: F.to_json(F.transform(authors, lambda a: F.array_join(a[field], "; ")))
    return [
        F.col(f"{paper}.arxiv_id").alias("arxiv_id"),
        F.to_json(F.transform(authors, lambda a: a["name"])).alias("authors"),
        joined("affiliations").alias("affiliations"),
        joined("countries").alias("countries"),
        F.coalesce(F.get(F.col(f"{paper}.first_author_countries"), F.lit(0)), F.lit("")).alias("first_author_country"),
    ]


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normal_title(title: Column) -> Column:
    """A title for comparison: compatibility form without accents, formulas, punctuation and case.

    Titles of plain ASCII never leave the JVM.
    """
    bare = F.when(title.rlike(r"[^\x00-\x7f]"), F.regexp_replace(_compatible(F.when(title.rlike(r"[^\x00-\x7f]"), title)), r"\p{M}", "")).otherwise(title)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(bare), r"\$[^$]*\$", " "), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Text with its HTML entities resolved."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def category_name(code: Column, names: dict[str, str]) -> Column:
    """The name of a subject code: its prefix goes, then the names replace codes one after another, in order."""
    found = F.regexp_replace(code, r"^[\w-]+\.", "")
    for short, name in names.items():
        found = F.replace(found, F.lit(short), F.lit(name))
    return found


@F.pandas_udf(RENDERED)
def rendered_authors(pages: pd.Series) -> pd.Series:
    """Authors and affiliations of rendered papers, whose markup names them by class.

    Marks in superscript tie them; notes inside an author's element are the author's own; a single affiliation
    without a mark goes to all authors.
    """
    plain = lambda t: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", t))).strip(" ,;")

    def parse(page: str | None) -> list[dict]:
        found, marked, alone = [], {}, []
        for part in re.split(r'<span class="[^"]*ltx_creator', page or "")[1:]:
            name = re.search(r'<span class="[^"]*ltx_personname[^"]*">(.*?)</span>', part, re.S)
            if not name:
                continue
            marks = [m for s in re.findall(r"<sup[^>]*>(.*?)</sup>", name[1], re.S) for m in re.split(r"[,\s]+", plain(s)) if m]
            own = [plain(re.sub(r"<sup[^>]*>.*?</sup>", "", a, flags=re.S)) for a in re.findall(r'<span class="[^"]*ltx_role_(?:affiliation|address|institutetext)[^"]*">(.*?)</span>', part, re.S)]
            found.append([plain(re.sub(r"<sup[^>]*>.*?</sup>", "", name[1], flags=re.S)), marks, [a for a in own if a]])
        for line in re.findall(r'<(?:p|span) class="[^"]*ltx_(?:p|note_affiliation)[^"]*">\s*(<sup.*?)</(?:p|span)>', page or "", re.S):
            mark = re.match(r"<sup[^>]*>(.*?)</sup>(.*)", line, re.S)
            marked[plain(mark[1])] = plain(mark[2])
        alone = [a for _, _, own in found for a in own]
        rows = [(name, own + [marked[m] for m in marks if m in marked]) for name, marks, own in found]
        if len(set(alone)) == 1 and not marked:
            rows = [(name, a or alone[:1]) for name, a in rows]
        return [{"author": name, "affiliations": list(dict.fromkeys(a))} for name, a in rows]

    return pages.map(parse)


def authors_with_affiliations(text: Column) -> Column:
    """``Last, First: aff; aff;; Other: aff`` as structs (author, affiliations); parts before any name belong to nobody."""
    parts = F.filter(F.transform(F.split(text, r";|\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.array().cast("array<struct<author: string, affiliations: array<string>>>")

    def step(done: Column, part: Column) -> Column:
        author = F.nullif(F.trim(F.regexp_extract(part, r"^([^:]+):", 1)), F.lit(""))
        first = F.filter(F.array(F.trim(F.regexp_replace(part, r"^[^:]+:", ""))), lambda x: x != "")
        new = F.concat(done, F.array(F.struct(author.alias("author"), first.alias("affiliations"))))
        last = F.element_at(done, -1)
        more = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["author"].alias("author"), F.array_append(last["affiliations"], part).alias("affiliations"))))
        return F.when(author.isNotNull(), new).when(F.size(done) > 0, more).otherwise(done)

    return F.aggregate(parts, start, step)
