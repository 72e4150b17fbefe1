"""Column expressions over lists."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def mapped_items(items: str | Column, names: dict[str, str]) -> Column:
    """Items replaced by a small dictionary; others stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(items, lambda x: F.coalesce(F.try_element_at(pairs, x), x))


def padded_to(items: str | Column, size: int) -> Column:
    """A list with nulls up to a size."""
    missing = F.greatest(F.lit(size) - F.size(items), F.lit(0))
    return F.concat(items, F.array_repeat(F.lit(None).cast("string"), missing))


def split_clean(text: Column, separator: str) -> Column:
    """The trimmed, non-empty parts of a text."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def with_item(items: str | Column, item: str) -> Column:
    """A list with an item at its end unless it has it."""
    return F.when(F.array_contains(items, item), F.col(items) if isinstance(items, str) else items).otherwise(F.array_append(items, F.lit(item)))


def inverted(rows: DataFrame, canonical: str, aliases: str, name: str) -> DataFrame:
    """One row per alias."""
    return rows.select(F.explode(aliases).alias(name), canonical)


def distinct_ignoring_case(items: str | Column) -> Column:
    """Items without those that differ from an earlier one in case only."""
    keyed = F.array_sort(F.transform(items, lambda x, k: F.struct(F.lower(x).alias("low"), k.alias("at"), x.alias("item"))))
    # the sorted list as a lambda's variable, so that it is made once and not for every item
    first = lambda s: F.filter(s, lambda x, k: (k == 0) | ~F.get(s, k - 1)["low"].eqNullSafe(x["low"]))
    kept = F.get(F.transform(F.array(keyed), first), F.lit(0))
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["at"], s["item"]))), lambda s: s["item"])


def has_all(items: Column, *wanted: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), items)) == 0


def pairs_text(a: str, b: str) -> Column:
    """ "a: b" pairs joined by semicolons, up to the shorter list."""
    many = F.least(F.size(a), F.size(b))
    return F.array_join(F.zip_with(F.slice(a, 1, many), F.slice(b, 1, many), lambda x, y: F.concat(x, F.lit(": "), y)), "; ")


@F.pandas_udf(ArrayType(StringType()))
def _literal(texts: pd.Series) -> pd.Series:
    def parse(text: str | None) -> list | None:
        try:
            value = ast.literal_eval(text or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [None if x is None else str(x) for x in value] if isinstance(value, list | tuple) else None

    return texts.map(parse)


def parsed_list(text: Column, on_error: str = "null") -> Column:
    """A stored list literal, such as ``['a', None]``, as an array of strings.

    Most literals are JSON but for their quotes and None, and stay in the JVM; only the others, those with escapes or
    inner quotes, go through Python. Blank text is null. ``on_error``: what becomes of other text: ``null``,
    ``empty`` (list) or ``wrap`` (a list of it).
    """
    plain = text.rlike(r"""^\s*\[\s*((('[^'"\\]*')|("[^"\\]*")|None)\s*(,\s*(('[^'"\\]*')|("[^"\\]*")|None)\s*)*)?\]\s*$""")
    as_json = F.regexp_replace(F.regexp_replace(text, r"(?<=[\[,])\s*None\s*(?=[,\]])", "null"), r"'([^'\"\\]*)'", '"$1"')
    fast = F.from_json(as_json, "array<string>")
    slow = _literal(F.when(~plain, text))
    failed = {"null": F.lit(None).cast("array<string>"), "empty": F.array().cast("array<string>"), "wrap": F.array(text)}[on_error]
    return F.when(F.trim(text) == "", None).otherwise(F.when(plain, fast).otherwise(F.when(text.isNull(), None).otherwise(F.coalesce(slow, failed))))
