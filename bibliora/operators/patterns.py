"""Banks of regular expressions: many patterns searched in many texts at the cost of what is found.

A pattern that can only match where some literal stands has a required factor: one of a few strings is in every match.
The factors of all patterns go into one automaton, which reads each text once, and a pattern is only tried on texts that
have one of its factors. Patterns without a factor (``\\d+``) are tried on every text. Patterns are Python's; letters are
compared without case unless asked otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from operator import itemgetter
from re import _constants as node
from re import _parser as parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .dictionaries import HITS, PART_TERMS

#: A factor has at most so many spellings; longer classes and alternations end it.
SPELLINGS = 32
_REPEATS = (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT)


def folded(text: str) -> str:
    """A text in which characters that match each other without case are the same."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def required_factors(pattern: str) -> frozenset[str] | None:
    """Folded strings of which every match of a pattern has one, the most telling that are found; None if there are none."""
    return _required(parser.parse(pattern))


def _spellings(kind, value) -> set[str] | None:
    """All that a part of a pattern can match, if that is few strings."""
    if kind is node.LITERAL:
        return {chr(value)}
    if kind in (node.AT, node.ASSERT, node.ASSERT_NOT):
        return {""}
    if kind is node.IN:
        letters: set[str] = set()
        for inner, x in value:
            if inner is node.LITERAL:
                letters.add(chr(x))
            elif inner is node.RANGE and x[1] - x[0] < SPELLINGS:
                letters |= {chr(n) for n in range(x[0], x[1] + 1)}
            else:
                return None
        return letters
    if kind is node.SUBPATTERN:
        return _all(value[-1])
    if kind is node.ATOMIC_GROUP:
        return _all(value)
    if kind is node.BRANCH:
        branches = [_all(b) for b in value[1]]
        return None if None in branches else set().union(*branches)
    if kind in _REPEATS and value[1] <= 3:
        once = _all(value[2])
        if once is not None:
            every = [{"".join(p) for p in product(once, repeat=n)} for n in range(value[0], value[1] + 1) if len(once) ** n <= SPELLINGS]
            return set().union(*every) if len(every) == value[1] - value[0] + 1 else None
    return None


def _all(sequence) -> set[str] | None:
    """All that a sequence can match, if that is few strings."""
    found = {""}
    for kind, value in sequence:
        part = _spellings(kind, value)
        if part is None or len(part) * len(found) > SPELLINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _inner(kind, value) -> frozenset[str] | None:
    """The required factors of a part that can match many strings."""
    if kind is node.SUBPATTERN:
        return _required(value[-1])
    if kind is node.ATOMIC_GROUP:
        return _required(value)
    if kind in _REPEATS and value[0] > 0:
        return _required(value[2])
    if kind is node.BRANCH:
        branches = [_required(b) for b in value[1]]
        together = None if None in branches else frozenset().union(*branches)
        return together if together and len(together) <= SPELLINGS else None
    return None


def _required(sequence) -> frozenset[str] | None:
    found: list[frozenset[str] | None] = []
    run = {""}
    for kind, value in sequence:
        part = _spellings(kind, value)
        if part is not None and len(part) <= SPELLINGS:
            if len(part) * len(run) > SPELLINGS:
                found.append(frozenset(run))
                run = {""}
            run = {a + b for a in run for b in part}
        else:
            found += [frozenset(run), _inner(kind, value)]
            run = {""}
    found.append(frozenset(run))
    usable = [frozenset(map(folded, f)) for f in found if f and "" not in f]
    return max(usable, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def bank(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """A bank from (pattern, ord) or (pattern, canonical, ord), as ``dictionaries.terms`` makes a dictionary."""
    return spark.createDataFrame([(e[0], e[-2] if len(e) == 3 else e[0], e[-1]) for e in entries], "term string, canonical string, ord int")


class Searcher:
    """Finds which patterns of a list match a text."""

    def __init__(self, patterns: list[str], case_sensitive: bool) -> None:
        self.compiled = [re.compile(p, 0 if case_sensitive else re.IGNORECASE) for p in patterns]
        self.always: list[int] = []
        self.automaton = ahocorasick.Automaton()
        by_factor: dict[str, list[int]] = {}
        for number, pattern in enumerate(patterns):
            factors = required_factors(pattern)
            if factors is None:
                self.always.append(number)
            for factor in factors or ():
                by_factor.setdefault(factor, []).append(number)
        for factor, numbers in by_factor.items():
            self.automaton.add_word(factor, tuple(numbers))
        if by_factor:
            self.automaton.make_automaton()
        self.tried = 0

    def candidates(self, text: str) -> list[int]:
        """The patterns that a text may match."""
        sets = set(map(itemgetter(1), self.automaton.iter(folded(text)))) if len(self.automaton) else ()
        return sorted({n for s in sets for n in s}.union(self.always))

    def matches(self, text: str, count: bool) -> Iterator[tuple[int, int]]:
        """(pattern, occurrences) of the patterns that match; with ``count`` occurrences that do not overlap, else 1."""
        for number in self.candidates(text):
            self.tried += 1
            if count:
                many = sum(1 for _ in self.compiled[number].finditer(text))
                if many:
                    yield number, many
            elif self.compiled[number].search(text):
                yield number, 1


def pattern_matches(rows: DataFrame, columns: list[str], patterns: DataFrame, count: bool = False, case_sensitive: bool = False) -> DataFrame:
    """For each row and each pattern that matches in one of ``columns``: the row's other columns and term, canonical, ord,
    hits and column, as ``dictionaries.matches`` gives them. The searched texts are not among them.

    Null texts match nothing; an empty pattern matches every text that is not null; a pattern that Python cannot compile
    is refused before anything is read.
    """
    parts = max(1, -(-patterns.count() // PART_TERMS))
    found = None
    for k in range(parts):
        entries = [tuple(e) for e in patterns.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select("term", "canonical", "ord").collect()]
        for term, _, _ in entries:
            re.compile(term)
        some = _search(rows, columns, entries, count, case_sensitive)
        found = some if found is None else found.union(some)
    return found


def _search(rows: DataFrame, columns: list[str], entries: list[tuple], count: bool, case_sensitive: bool) -> DataFrame:
    kept = [c for c in rows.columns if c not in columns]
    schema = StructType([*rows.select(kept).schema.fields, *StructType.fromDDL(HITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher([e[0] for e in entries], case_sensitive)
        for batch in batches:
            hits: list[tuple[int, int, int, int]] = []  # row, entry, occurrences, column
            for column in range(len(columns)):
                for row, text in enumerate(batch.column(len(kept) + column)):
                    if (content := text.as_py()) is not None:
                        hits += [(row, number, n, column) for number, n in searcher.matches(content, count)]
            row, number, n, column = (np.array([h[k] for h in hits], np.int32) for k in range(4))
            listed = [pa.array([entries[k][c] for k in number.tolist()], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).take(pa.array(row)).columns, *listed, pa.array(n), pa.array(column)], names=schema.names)

    return rows.select(*kept, *columns).mapInArrow(run, schema)
