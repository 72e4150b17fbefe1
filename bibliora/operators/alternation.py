"""Terms of a dictionary as one alternation over the lines of a text: leftmost, then longest, with a stop at a gap.

The automaton of all terms reports every place where a term ends. Of the places that stand between word boundaries the
leftmost is taken, of those that start there the longest, and the search goes on behind it: what a regular expression
``\\b(term|term|...)\\b`` with the longest terms first finds. A text is left at the first gap without terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def _word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def lowered(text: str) -> str:
    """Lower case, letter for letter, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Alternation:
    """Finds the terms of a dictionary in texts; of terms that are equal without case the first gives the name."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        names: dict[str, str] = {}
        for term, name in entries:
            if term:
                names.setdefault(lowered(term), name)
        for term, name in names.items():
            self.automaton.add_word(term, (len(term), name))
        if names:
            self.automaton.make_automaton()
        self.any = bool(names)

    def find(self, text: str) -> list[str]:
        """The names of the terms found, in order, with repeats."""
        if not self.any:
            return []
        low = lowered(text)
        places = []
        for last, (size, name) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            opens = (start > 0 and _word(low[start - 1])) != _word(low[start])
            closes = _word(low[last]) != (end < len(low) and _word(low[end]))
            if opens and closes:
                places.append((start, -end, name))
        found, free = [], 0
        for start, end, name in sorted(places):
            if start >= free:
                found.append(name)
                free = -end
        return found

    def until_gap(self, lines: list[str], gap: int) -> list[str]:
        """The names found line by line, up to the first ``gap`` lines in a row without any after one with some."""
        found: list[str] = []
        empty = 0
        for line in lines:
            names = self.find(line)
            if names:
                found += names
                empty = 0
            elif found:
                empty += 1
                if empty >= gap:
                    break
        return found


def terms_until_gap(rows: DataFrame, key: str, text: str, dictionary: list[tuple[str, str]], gap: int = 30) -> DataFrame:
    """(key, found): the canonical names of the terms in each text's lines, in order and with repeats, up to the first gap.

    The dictionary is a list of (term, name), small as a country list is. A null text has none.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alternation = Alternation(dictionary)
        for batch in batches:
            found = [alternation.until_gap((content.as_py() or "").split("\n"), gap) for content in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=[key, "found"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, found array<string>")
