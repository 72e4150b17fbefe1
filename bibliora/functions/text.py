"""Column expressions over texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a redshift mention, with its operator and its number.
REDSHIFT = r"(?i)\bz\s*([<>=~]*)\s*(\d+(\.\d+)?)"


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_path_part(url: Column) -> Column:
    """The last part of a URL's path without query, fragment and ``.pdf``."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(url, "/"), -1), "[?#].*$", ""), r"\.pdf$", "")


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\(.*?\)", ""))


def after_markers(text: Column, *markers: str) -> Column:
    """What follows the last occurrence of a marker; of several markers present the last one given counts."""
    found = F.lit(None).cast("string")
    for marker in markers:
        found = F.when(text.contains(marker), F.substring_index(text, marker, -1)).otherwise(found)
    return found


def number_before(text: Column, unit: str) -> Column:
    """The first whole number before a unit."""
    return extracted(text, rf"(\d+)\s+{unit}").try_cast("int")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null (a word by the name of its missing value would be one too many)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def clean_keywords(text: Column) -> Column:
    """A keyword list without ids in brackets, list marks, lone ones and colons. The order of the steps matters."""
    for pattern, to in ((r"\(\d+\)", ""), (r"\[\d+\]", ""), (r"[\[\]']", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\b1\b", ""), ":", "")


def rewritten(text: Column, terms: dict[str, str], whole_words: bool) -> Column:
    """Terms replaced one after another, in the order given."""
    for old, new in terms.items():
        text = F.regexp_replace(text, rf"\b\Q{old}\E\b", new) if whole_words else F.replace(text, F.lit(old), F.lit(new))
    return text


def redshift_mentions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, op, value) of every mention in a text."""
    operators = F.regexp_extract_all(text, F.lit(REDSHIFT), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(REDSHIFT), F.lit(2))
    pairs = F.zip_with(operators, values, lambda o, v: F.struct(F.coalesce(F.nullif(o, F.lit("")), F.lit("=")).alias("op"), v.cast("double").alias("value")))
    return rows.select(key, F.inline(pairs))


def mentions(rows: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """(name, n): how often each match of a pattern occurs, spaces left out."""
    found = rows.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_x"))
    return found.groupBy(F.replace("_x", F.lit(" "), F.lit("")).alias(name)).agg(F.count("*").alias("n"))


def without_orcid(name: Column) -> Column:
    """A LaTeX name without its ORCID link, with plain single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(name, r"\\orcidlink\{[^}]*\}", ""), F.lit("~"), F.lit(" ")), r"\s+", " "))


def cut_after(text: Column, marker: str, more: int, otherwise: int) -> Column:
    """Up to ``more`` characters after a marker, or the first ``otherwise`` where it is missing."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, F.lit(1), at + more)).otherwise(F.left(text, F.lit(otherwise)))


def without_comments(text: Column) -> Column:
    """LaTeX text without comments."""
    return F.regexp_replace(text, r"%[^\n]*", "")


def largest_reference(text: Column, word: str) -> Column:
    """The largest number after a word such as "figure"."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){word}\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("int")))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)), F.lit(""))


def outermost_object(answer: Column) -> Column:
    """The text from the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
