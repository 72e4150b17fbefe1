"""Pages of an archive of papers, read by their structure: a paper's own page, listings of months, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.markup import Path, Step, extracted

#: Phrases after which comments name a journal, the later the stronger.
VENUE_MARKERS = ("Submitted to ", "Accepted to ", "Accepted for publication in ", "Accepted by ", "Submitted by ")
#: How the front matter of a paper announces its keywords, and what ends them.
KEYWORD_LINE = r"(?is)(?:keyword[s]?|Uniﬁed Astronomy Thesaurus concepts?|key words?|Subject headings)[:.]?\s*(.*?)\s*(?=(?:[.;]|\n|$))"
STOP_PHRASES = ("1. Introduction", "1 Introduction")


def _labelled(label: str, name: str) -> list[Path]:
    """The cell beside a label of a table: by its class, or else any, or the rest of what holds the label in the newer layout."""
    cell = Step("td", ("tablecell", "label"), text=label)
    return [(cell, Step("td", ("tablecell", name), relation="sibling")), (cell, Step("td", relation="sibling")), (Step("span", ("descriptor",), text=label), Step(relation="parent"))]


def _first(name: str, label: str | None = None) -> Column:
    """The text of a field's first element without its label; null if it is missing or empty."""
    content = F.get(F.col(name), F.lit(0))["text"]
    return F.nullif(F.trim(F.regexp_replace(content, f"^{label}:", "") if label else content), F.lit(""))


def comments_and_journal(pages: DataFrame, html: str) -> DataFrame:
    """Other columns with ``comments`` and ``journals`` of a paper's page, each by three ways in turn."""
    fields = {"_comments": _labelled("Comments:", "arx-comment"), "_journals": _labelled("Journal-ref:", "jref")}
    kept = [c for c in pages.columns if c != html]
    return extracted(pages, html, fields).select(*kept, _first("_comments", "Comments").alias("comments"), _first("_journals", "Journal-ref").alias("journals"))


def paper_page(pages: DataFrame, html: str) -> DataFrame:
    """Other columns with what a paper's page states: title, abstract, authors, comments, counts of figures, pages and
    tables, subjects, journals, and the day it was submitted. Missing parts are null; missing authors an empty list."""
    mathjax = lambda tag, name: [(Step(tag, (name, "mathjax")),)]
    subjects = Step("td", ("tablecell", "subjects"))
    fields = {
        "_title": mathjax("h1", "title"), "_abstract": mathjax("blockquote", "abstract"), "_authors": [(Step("div", ("authors",)), Step("a"))],
        "_comments": [(Step("td", ("tablecell", "comments", "mathjax")),), *_labelled("Comments:", "comments")], "_journal": [(Step("td", ("tablecell", "jref")),), *_labelled("Journal-ref:", "jref")],
        "_subjects": [(subjects,)], "_primary": [(subjects, Step("span", ("primary-subject",)))], "_dateline": [(Step("div", ("dateline",)),)],
    }
    kept = [c for c in pages.columns if c != html]
    rows = extracted(pages, html, fields).withColumns({"comments": _first("_comments", "Comments"), "_all": _first("_subjects"), "_own": _first("_primary")})
    parts = F.filter(F.transform(F.split("_all", ";"), lambda s: F.trim(s)), lambda s: ~F.contains(s, F.col("_own")) & (s != ""))
    submitted = F.regexp_extract(_first("_dateline"), r"Submitted on (\d{1,2} \w+ \d{4})", 1)
    return rows.select(
        *kept, _first("_title", "Title").alias("title"), _first("_abstract", "Abstract").alias("abstract"), F.transform("_authors", lambda a: a["text"]).alias("authors"), "comments",
        *(fn.number_before(F.col("comments"), unit).alias(name) for name, unit in (("figures", "figures"), ("pages", "pages"), ("tables", "tables?"))),
        F.coalesce("_own", "_all").alias("primary_subject"), F.when(F.size(parts) > 0, parts).alias("secondary_subjects"),
        fn.after_markers(F.col("comments"), *VENUE_MARKERS).alias("submitted_journal"), _first("_journal", "Journal-ref").alias("published_journal"), F.try_to_date(submitted, "d MMM yyyy").alias("date"),
    )


def month_listing(pages: DataFrame, html: str, month: str, targets: DataFrame) -> DataFrame:
    """(month, position, id, title) of listing pages: the pairs of dt and dd in order, position from 1.

    ``targets`` (month, target) says how many pairs of a month are new papers; those after them are passed over, as are
    entries without a link titled "Abstract". A month without a target keeps none.
    """
    entry = (Step("dt"),)
    fields = {"_link": [(Step("dt"), Step("a", attributes=(("title", "Abstract"),)))], "_name": [(Step("dd"), Step("div", ("list-title", "mathjax")))]}
    rows = extracted(pages.select(F.col(month).alias("month"), F.col(html).alias("html")), "html", fields, records=entry)
    listed = rows.select("month", (F.col("record") + 1).alias("position"), F.trim(F.replace(_first("_link"), F.lit("arXiv:"), F.lit(""))).alias("id"), F.coalesce(_first("_name", "Title"), F.lit("Unknown Title")).alias("title"))
    return listed.join(targets.select("month", "target"), "month").filter("position <= target AND id IS NOT NULL").drop("target")


def front_keywords(content: Column) -> Column:
    """The distinct keywords that a paper's text announces, without what comes after the start of the introduction."""
    lists = F.regexp_extract_all(F.regexp_replace(content, r"\s+", " "), F.lit(KEYWORD_LINE), F.lit(1))
    words = F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, "[;,\n]"))), lambda w: F.trim(w)), lambda w: w != "")
    found = F.array_distinct(words)
    return F.when(_has(found, STOP_PHRASES[0]), _until(found, STOP_PHRASES[0])).when(_has(found, STOP_PHRASES[1]), _until(found, STOP_PHRASES[1])).otherwise(found)


def _has(words: Column, phrase: str) -> Column:
    return F.exists(words, lambda w: F.contains(w, F.lit(phrase)))


def _until(words: Column, phrase: str) -> Column:
    """The words before a phrase that one of them holds, that one cut at the phrase."""
    place = F.array_position(F.transform(words, lambda w: F.contains(w, F.lit(phrase))), F.lit(True)).cast("int")
    cut = F.transform(F.slice(words, F.lit(1), place), lambda w: F.trim(F.substring_index(w, phrase, 1)))
    return F.filter(cut, lambda w: w != "")
