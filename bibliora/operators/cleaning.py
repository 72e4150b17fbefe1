"""Column expressions for missing values, holes in lists and untrusted numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing list.
MISSING = ("", "[]", "['']", '[""]', "nan", "none")


def number_or_null(text: Column) -> Column:
    """A text as a double, null where it is none: a plain cast would fail in ANSI mode."""
    return text.try_cast("double")


def sentinels_to_null(text: Column, *sentinels: str) -> Column:
    """Blank text and the given sentinels become null."""
    return F.when(~F.trim(text).isin("", *sentinels), text)


def is_missing(text: Column) -> Column:
    """Whether a stored list or text says "nothing" in any of its forms."""
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING)


def _empty_slot(x: Column) -> Column:
    return x.isNull() | (F.lower(F.trim(x)) == "none")


def has_hole(slots: Column) -> Column:
    """Whether a list is missing or has an unknown entry."""
    return slots.isNull() | F.coalesce(F.exists(slots, _empty_slot), F.lit(False))


def is_full(slots: Column) -> Column:
    """Whether a list is there and all its entries are known."""
    return ~has_hole(slots)


def holes(slots: Column) -> Column:
    """How many entries are unknown; null for a missing list."""
    return F.when(slots.isNotNull(), F.size(F.filter(slots, _empty_slot)))


def contains_any(text: Column, *parts: str) -> Column:
    """Whether a text contains any of the parts."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def bare_keyword(keyword: Column) -> Column:
    """A keyword without a number in parentheses at its end; null for an e-mail address."""
    bare = F.trim(F.regexp_replace(keyword, r"\s*\(\d+\)\s*$", ""))
    return F.when(~bare.rlike(r"^[^@\s]+@[^@\s]+$"), bare)
