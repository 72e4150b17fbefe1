"""Joining names across their spellings: order of parts, letters with marks, initials.

A name is rewritten into its spellings, cheapest first, by a weighted transducer: the order of its parts may turn, given
names may shrink to initials, and each letter with a mark may become two letters, one letter, or ``v``. Names of both
sides meet in a common spelling, and the rank of a pair is the least cost of one. A name of very many marked letters has
more spellings than are written out; it meets others by a skeleton that all spellings share, and the pair is ranked by a
search over both names at once, so that nothing is lost.

Ranks: 0 as written (without case, blanks and hyphens), 1 for turned parts, 2 for each letter written with two or one, 3 for
each ``v``, 6 for initials; costs add up over both names.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNED, LETTERS, AS_V, INITIALS = 1, 2, 3, 6
#: Spellings of a name that are written out.
MOST = 64
#: Letters that are written with two where marks are missing.
TWO_LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "oe", "å": "aa", "æ": "ae", "œ": "oe"}
_SAME = re.compile(r"(?<=a)[ea]|(?<=o)e|(?<=u)e|(?<=s)s")


@lru_cache(4096)
def options(letter: str) -> list[tuple[str, int]]:
    """How a letter may be written, and what that costs."""
    found = [(letter, 0)]
    if letter in TWO_LETTERS:
        found.append((TWO_LETTERS[letter], LETTERS))
    bare = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
    bare = {"ø": "o", "ß": "s", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ı": "i"}.get(letter, bare)
    if bare != letter:
        found.append((bare, LETTERS))
    if letter == "ü":
        found.append(("v", AS_V))
    return found


def forms(name: str | None) -> list[tuple[str, int]]:
    """A name's orders of parts, in lower case and run together, each with its cost: "Last, First" counts as "First Last"."""
    name = unicodedata.normalize("NFC", (name or "").lower())
    last, comma, first = name.partition(",")
    parts = [p for p in (f"{first} {last}" if comma else name).split() if p.strip("-.")]
    if not parts:
        return []
    joined = lambda some: "".join(some).replace("-", "").replace(".", "")
    found = {joined(parts): 0}
    if len(parts) > 1:
        short = [p.lstrip("-.")[0] for p in parts[:-1]]
        for some, cost in (([parts[-1], *parts[:-1]], TURNED), ([*short, parts[-1]], INITIALS), ([parts[-1], *short], INITIALS + TURNED)):
            found.setdefault(joined(some), cost)
    return [(f, c) for f, c in found.items() if f]


def spellings(name: str | None, most: int = MOST) -> tuple[list[tuple[str, int]], bool]:
    """The cheapest spellings of a name with their ranks, and whether these are all."""
    listed = forms(name)
    if len(listed) <= most and all(form.isascii() for form, _ in listed):  # no letter has a choice
        return sorted(listed, key=lambda f: (f[1], f[0])), True
    heap = [(cost, "", form) for form, cost in listed]
    heapq.heapify(heap)
    found: dict[str, int] = {}
    while heap:
        cost, done, rest = heapq.heappop(heap)
        plain = next((k for k, letter in enumerate(rest) if len(options(letter)) > 1), len(rest))
        done, rest = done + rest[:plain], rest[plain:]
        if rest:
            for text, more in options(rest[0]):
                heapq.heappush(heap, (cost + more, done + text, rest[1:]))
        elif done not in found:
            if len(found) == most:
                return list(found.items()), False
            found[done] = cost
    return list(found.items()), True


def common_rank(a: str | None, b: str | None) -> int | None:
    """The least cost of a spelling that two names have in common, by a search over both at once; None if there is none."""
    heap = [(c + d, x, y, "", "") for x, c in forms(a) for y, d in forms(b)]
    heapq.heapify(heap)
    seen = set()
    while heap:
        cost, x, y, left, right = heapq.heappop(heap)
        if (x, y, left, right) in seen:
            continue
        seen.add((x, y, left, right))
        if not (x or y or left or right):
            return cost
        # the side that is behind writes its next letter; what one has written beyond the other waits
        for (text, more) in options(x[0]) if x and not left else ():
            _go_on(heap, cost + more, x[1:], y, left + text, right)
        if y and not right and (left or not x):
            for text, more in options(y[0]):
                _go_on(heap, cost + more, x, y[1:], left, right + text)
    return None


def _go_on(heap: list, cost: int, x: str, y: str, left: str, right: str) -> None:
    many = min(len(left), len(right))
    if left[:many] == right[:many]:
        heapq.heappush(heap, (cost, x, y, left[many:], right[many:]))


def skeletons(name: str | None) -> list[str]:
    """Keys of a name that it shares with every name it has a spelling in common with: one for each order of its parts."""
    found = []
    for form, _ in forms(name):
        bare = form if form.isascii() else "".join(map(_barest, form))
        found.append(_SAME.sub("", bare.replace("v", "u")))
    return list(dict.fromkeys(found))


@lru_cache(4096)
def _barest(letter: str) -> str:
    return min((t for t, _ in options(letter)), key=lambda t: (not t.isascii(), len(t), t == "v"))


def beyond(name: str | None, most: int = MOST) -> bool:
    """Whether a name has more spellings than are written out."""
    many = sum(1 if form.isascii() else prod(len(options(c)) for c in form) for form, _ in forms(name))
    return many > most and not spellings(name, most)[1]


def by_spelling(left: DataFrame, left_key: str, left_name: str, right: DataFrame, right_key: str, right_name: str, most: int = MOST) -> DataFrame:
    """(left_key, right_key, rank) of all pairs of rows whose names have a spelling in common, with the least rank.

    Null and empty names match nothing. Different names are rewritten once, however many rows have them.
    """

    pairs = meetings(left.select(left_name), right.select(right_name), most)
    left_rows, right_rows = left.select(left_key, F.col(left_name).alias("_a_name")), right.select(right_key, F.col(right_name).alias("_b_name"))
    return left_rows.join(pairs, "_a_name").join(right_rows, "_b_name").select(left_key, right_key, "rank")


def meetings(left: DataFrame, right: DataFrame, most: int = MOST) -> DataFrame:
    """(_a_name, _b_name, rank) of the different names in two columns that have a spelling in common, once each.

    Names whose spellings are all written out meet in these. Skeletons join only pairs of which one has more: ``kind`` 1 for
    the left one with any name, 2 for the right one with the others, so that no pair is made in vain.
    """

    def spelled(name: str) -> list[tuple]:
        listed, complete = spellings(name, most)
        return [(name, text, rank) for text, rank in listed] if complete else []

    def keyed(mine: int, other: int) -> Callable[[str], list[tuple]]:
        def keys(name: str) -> list[tuple]:
            kinds = (mine, other) if mine == 2 else (mine,)
            return [(name, key, kind) for key in skeletons(name) for kind in (kinds if beyond(name, most) else (other,))]

        return keys

    def each(names: DataFrame, side: str, rows: Callable[[str], list[tuple]], number: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [row for name in batch.column(0).to_pylist() for row in rows(name)]
                columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"_{side}_name", "text", number])

        return names.toDF("name").dropna().distinct().mapInArrow(run, f"_{side}_name string, text string, {number} int")

    met = each(left, "a", spelled, "_a_rank").join(each(right, "b", spelled, "_b_rank"), "text").select("_a_name", "_b_name", (F.col("_a_rank") + F.col("_b_rank")).alias("rank"))
    # left: kind 1 if beyond, else 2; right: kinds 1 and 2 if beyond, else 1
    far = each(left, "a", keyed(1, 2), "kind").join(each(right, "b", keyed(2, 1), "kind"), ["text", "kind"]).select("_a_name", "_b_name").distinct()
    ranked = far.select("_a_name", "_b_name", F.udf(common_rank, "int", useArrow=False)("_a_name", "_b_name").alias("rank")).filter("rank IS NOT NULL")
    return met.unionByName(ranked).groupBy("_a_name", "_b_name").agg(F.min("rank").alias("rank"))
