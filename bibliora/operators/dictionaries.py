"""Matching texts against dictionaries of terms: one operator, several policies.

A dictionary is a table (term, canonical, ord); ``ord`` is the order of precedence. Its terms become an automaton that
finds all of them in one pass over a text, whatever their number, in tasks over Arrow batches. A dictionary of more
than PART_TERMS terms is used in parts of about that many, so what tasks hold is bounded and no term is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART_TERMS = 50_000
HITS = "term string, canonical string, ord int, hits int, column int"


def terms(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """A dictionary from (term, ord) or (term, canonical, ord); a term given twice is refused."""
    rows = [(e[0], e[-2] if len(e) == 3 else e[0], e[-1]) for e in entries]
    if len({r[0].lower() for r in rows}) < len(rows):
        raise ValueError("a term is in the dictionary twice")
    return spark.createDataFrame(rows, "term string, canonical string, ord int")


def matches(rows: DataFrame, columns: list[str], dictionary: DataFrame, boundary: bool = True, case_sensitive: bool = False) -> DataFrame:
    """The other columns of ``rows`` with each term found in any of ``columns``: term, canonical, ord, hits (occurrences
    that do not overlap each other) and column (its place). Terms that overlap other terms all count; empty terms are
    nowhere. The searched texts do not come back, so a hit is a few values.

    With ``boundary`` no letter, digit or underscore stands beside an occurrence; texts and terms are lower-cased unless
    ``case_sensitive``.
    """
    named = dictionary.filter("term <> ''")
    parts = max(1, -(-named.count() // PART_TERMS))
    found = None
    for k in range(parts):
        entries = named.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select("term", "canonical", "ord").collect()
        some = _matches(rows, columns, [tuple(e) for e in entries], boundary, case_sensitive)
        found = some if found is None else found.union(some)
    return found


def _matches(rows: DataFrame, columns: list[str], entries: list[tuple], boundary: bool, case_sensitive: bool) -> DataFrame:
    kept = [c for c in rows.columns if c not in columns]
    schema = StructType([*rows.select(kept).schema.fields, *StructType.fromDDL(HITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, by_key = ahocorasick.Automaton(), {}
        for number, entry in enumerate(entries):
            by_key.setdefault(entry[0] if case_sensitive else entry[0].lower(), []).append(number)
        for key, numbers in by_key.items():
            automaton.add_word(key, (len(key), numbers))
        automaton.make_automaton()
        for batch in batches:
            hits: list[tuple[int, int, int, int]] = []  # row, entry, occurrences, column
            for column in range(len(columns) if entries else 0):
                for row, value in enumerate(batch.column(len(kept) + column)):
                    if text := value.as_py():
                        hits += [(row, number, n, column) for number, n in _occurrences(automaton, text if case_sensitive else text.lower(), boundary)]
            row, number, n, column = (np.array([h[k] for h in hits], np.int32) for k in range(4))
            listed = [pa.array([entries[k][c] for k in number.tolist()], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).take(pa.array(row)).columns, *listed, pa.array(n), pa.array(column)], names=schema.names)

    return rows.select(*kept, *columns).mapInArrow(run, schema)


def _occurrences(automaton: ahocorasick.Automaton, text: str, boundary: bool) -> list[tuple[int, int]]:
    """(entry, occurrences) of the entries that a text has."""
    until: dict[int, int] = {}
    counts: dict[int, int] = {}
    for last, (size, numbers) in automaton.iter(text):
        first, after = last - size + 1, last + 1
        if boundary and ((first and _inside(text[first - 1])) or (after < len(text) and _inside(text[after]))):
            continue
        if first >= until.get(numbers[0], 0):
            for number in numbers:
                until[number] = after
                counts[number] = counts.get(number, 0) + 1
    return sorted(counts.items())


def _inside(letter: str) -> bool:
    """Whether a character is part of a word: a letter, digit or underscore."""
    return letter.isalnum() or letter == "_"


def labelled(rows: DataFrame, key: str, columns: list[str], dictionary: DataFrame, policy: str, label: str, otherwise: str | None = None, boundary: bool = True, case_sensitive: bool = False) -> DataFrame:
    """(key, label): the canonical term of each row by a policy.

    ``first``: the lowest ord; ``last``: the highest; ``longest``: the longest term; ``most_frequent``: the canonical
    with most occurrences, ties to its lowest ord; ``last_column``: the first term of the last column that has one.
    """
    hits = matches(rows.select(key, *columns), columns, dictionary, boundary, case_sensitive)
    if policy == "most_frequent":
        hits = hits.groupBy(key, "canonical").agg(F.sum("hits").alias("hits"), F.min("ord").alias("ord"))
    order = {
        "first": F.struct(F.col("ord")),
        "last": F.struct(-F.col("ord")),
        "longest": F.struct(-F.length("term"), F.col("ord")) if policy == "longest" else None,
        "most_frequent": F.struct(-F.col("hits"), F.col("ord")),
        "last_column": F.struct(-F.col("column"), F.col("ord")) if policy == "last_column" else None,
    }[policy]
    best = hits.groupBy(key).agg(F.min_by("canonical", order).alias(label))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce(F.col(label), F.lit(otherwise)).alias(label))


def subset_matches(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, term): terms all of whose words a text has, in any order: a join on words, then a count."""
    wanted = dictionary.select("term", F.array_distinct(F.regexp_extract_all(F.lower("term"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    wanted = wanted.select("term", F.size("w").alias("many"), F.explode("w").alias("word"))
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    return words.join(wanted, "word").groupBy(key, "term").agg(F.count("*").alias("n"), F.first("many").alias("many")).filter("n = many").select(key, "term")


def rolled_up(counts: DataFrame, column: str, mains: dict[str, str]) -> DataFrame:
    """(name, n): counts of aliases added up under their main names; a name without one keeps itself."""
    names = F.create_map(*[F.lit(x) for pair in mains.items() for x in pair])
    return counts.groupBy(F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)).alias("name")).agg(F.sum("n").alias("n"))
