"""Strategies for reading authors and affiliations, each with the evidence for what it found, and their dispatch in order.

A strategy knows one style of front matter and yields a hypothesis or nothing. The dispatcher takes the first strategy of
an order whose hypothesis ties an author to an affiliation. Evidence is counted, not guessed: authors that are tied, and
marks that lead to an affiliation among those that authors carry.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..functions import latex
from .front_matter import AUTHOR, BY_MARKS, BY_ORDER, SURE, UNTIED, _boxes, _lines_apart, _names, _unboxed

RESULT = StructType([StructField("strategy", StringType()), StructField("authors", ArrayType(AUTHOR)), StructField("coverage", DoubleType()), StructField("resolved", DoubleType()), StructField("confidence", DoubleType()), StructField("needs_review", BooleanType())])
_INST, _AFF = re.compile(r"\\inst\{([^}]+)\}"), re.compile(r"\\aff\{([^}]+)\}")
_LABEL = re.compile(r"\\label\{\w*?(\d+)\}")
_ARGUMENT, _PARTS, _AND = re.compile(r"\s*\{"), re.compile(r"\\and\b|\\\\|\n\s*\n"), re.compile(r"\\and\b")
_AT_START = re.compile(r"\s*\$\s*\^\s*\{?(\w+)\}?\s*\$|\s*\\textsuperscript\{(\w+)\}")


@dataclass
class Hypothesis:
    """What a strategy found: authors in order with their affiliations, and how many of their marks led to one."""

    strategy: str
    authors: list[tuple[str, list[str]]] = field(default_factory=list)
    marks: int = 0
    led: int = 0

    def tie(self, name: str, marks: list[str], known: dict[str, str], unresolved: str | None = None) -> None:
        """An author by marks; a mark that leads nowhere is passed over, or keeps a slot named ``unresolved``."""
        self.marks += len(marks)
        self.led += sum(m in known for m in marks)
        found = [known.get(m) or (f"{unresolved}({m})" if unresolved else "") for m in marks]
        self.authors.append((name, list(dict.fromkeys(a for a in found if a))))

    @property
    def tied(self) -> int:
        return sum(bool(a) for _, a in self.authors)

    @property
    def coverage(self) -> float:
        return self.tied / len(self.authors) if self.authors else 0.0

    @property
    def resolved(self) -> float:
        return self.led / self.marks if self.marks else 0.0

    @property
    def confidence(self) -> float:
        """How sure the way of tying is: by marks, if any led somewhere; by order; or not tied at all."""
        return 0.0 if not self.authors else BY_MARKS if self.led else BY_ORDER if self.tied else UNTIED


def _author_arguments(text: str) -> list[latex.Command]:
    return list(latex.commands(text, "author"))


def boxed(text: str) -> Hypothesis:
    """Boxes for names and for addresses, tied by the marks that lead the addresses' lines."""
    found = Hypothesis("boxed")
    content, marked = _lines_apart(latex.without("\\\\".join(c for _, _, c in _boxes(text)), "vspace", "hspace"))
    if marked:
        for name, marks in _names(content):
            found.tie(name, marks, marked)
    return found


def block(text: str) -> Hypothesis:
    """Names in the author argument and marked lines of addresses under them."""
    found = Hypothesis("block")
    for command in _author_arguments(text):
        content, marked = _lines_apart(_unboxed(command.content))
        if marked:
            for name, marks in _names(content):
                found.tie(name, marks, marked)
    return found


def noted(text: str) -> Hypothesis:
    """Marks by ``\\altaffilmark``, addresses by ``\\altaffiltext``."""
    found, marked = Hypothesis("noted"), {}
    for command in latex.commands(text, "altaffiltext"):
        if rest := _ARGUMENT.match(text, command.end):
            marked[command.content.strip()] = latex.plain(text[rest.end() : latex.closing(text, rest.end() - 1, "{}") - 1])
    if marked:
        for command in _author_arguments(text):
            for name, marks in _names(command.content):
                found.tie(name, marks, marked)
    return found


def labelled(text: str) -> Hypothesis:
    """Options of ``\\author`` name the labels of ``\\address`` or ``\\affiliation``."""
    found = Hypothesis("labelled")
    marked = {c.option: latex.plain(c.content) for c in latex.commands(text, "address", "affiliation", "affil") if c.option}
    if marked:
        for command in _author_arguments(text):
            labels = [x.strip() for x in command.option.split(",") if x.strip()]
            for name, marks in _names(command.content):
                found.tie(name, labels + marks, marked)
    return found


def _institutes(text: str) -> dict[str, str]:
    """Addresses by their mark: one in them, a label, the option of their command, or else the next free number."""
    marked: dict[str, str] = {}

    def put(mark: str | None, content: str) -> None:
        name = latex.plain(content)
        if name:
            number = 1
            while mark is None and str(number) in marked:
                number += 1
            marked[mark or str(number)] = name

    for command in latex.commands(text, "affiliation", "institute"):
        if _AFF.search(command.content):
            parts = _AFF.split(command.content)
            for mark, content in zip(parts[1::2], parts[2::2], strict=True):
                put(mark.strip(), content)
            continue
        for part in _PARTS.split(command.content):
            lead, label = _AT_START.match(part) or _INST.search(part), _LABEL.search(part)
            mark = next((g for g in lead.groups() if g), None) if lead else label[1] if label else command.option or None
            put(mark, (part[: lead.start()] + part[lead.end() :]) if lead else _LABEL.sub("", part))
    return marked


def mapped(text: str) -> Hypothesis:
    """Any numbered addresses; authors without a mark take the only address, or else the first."""
    found, marked = Hypothesis("mapped"), _institutes(text)
    for command in _author_arguments(text) if marked else ():
        for name, marks in _names(command.content):
            if marks:
                found.tie(name, marks, marked)
            else:
                only = list(marked.values()) if len(marked) == 1 else [marked["1"]] if "1" in marked else []
                found.authors.append((name, only))
    return found


def numbered(text: str) -> Hypothesis:
    """``\\inst`` behind names, ``\\institute`` by number or label; a number without an institute stays as unresolved."""
    found = Hypothesis("numbered")
    if "\\inst{" in text and "\\institute" in text:
        marked: dict[str, str] = {}
        for command in latex.commands(text, "institute"):
            for part in _AND.split(command.content):
                label = _LABEL.search(part)
                marked[label[1] if label else str(len(marked) + 1)] = latex.plain(_LABEL.sub("", part))
        for command in _author_arguments(text)[:1]:
            for piece in _AND.split(command.content):
                if name := latex.plain(_INST.sub(" ", piece)):
                    found.tie(name, [m for x in _INST.findall(piece) for m in x.replace(" ", "").split(",") if m], marked, "Unresolved Inst")
    return found


def sequential(text: str) -> Hypothesis:
    """An address belongs to the author before it."""
    found = Hypothesis("sequential")
    for command in latex.commands(text, "author", "affiliation"):
        if command.name == "author":
            found.authors.append((latex.plain(command.content), []))
        elif found.authors:
            found.authors[-1][1].append(latex.plain(command.content))
    return found


def numbered_block(text: str) -> Hypothesis:
    """One author argument with numbered names and, after the first line break, numbered addresses; unresolved numbers stay."""
    found = Hypothesis("numbered block")
    for command in _author_arguments(text)[:1]:
        names, _, addresses = command.content.partition("\\\\")
        pieces = re.split(r"\$\^\{(\d+)\}\$?", addresses)
        marked = {m: latex.plain(a) for m, a in zip(pieces[1::2], pieces[2::2], strict=True)}
        for name, marks in _names(names) if marked else ():
            found.tie(name, marks, marked, "Unresolved Affil")
    return found


Strategy = Callable[[str], Hypothesis]
#: The orders in which styles are tried.
BY_STYLE: tuple[Strategy, ...] = (boxed, block, noted, labelled, mapped)
BY_SOURCE: tuple[Strategy, ...] = (numbered, sequential, numbered_block)


def hypotheses(text: str | None, order: tuple[Strategy, ...] = BY_STYLE) -> list[Hypothesis]:
    """What every strategy of an order makes of a front matter."""
    bare = latex.without_comments(text or "")
    return [strategy(bare) for strategy in order]


def dispatch(text: str | None, order: tuple[Strategy, ...] = BY_STYLE) -> Hypothesis:
    """The first hypothesis of an order that ties an author; without one the first that has authors, or an empty one."""
    bare, authors = latex.without_comments(text or ""), None
    for strategy in order:
        found = strategy(bare)
        if found.tied:
            return found
        if authors is None and found.authors:
            authors = found
    return authors or Hypothesis("none")


def _lists(parts: list[list], values: pa.Array) -> pa.Array:
    """The values of all parts as one list for each part."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, parts))], pa.int32()), values)


def dispatched(text: Column, order: tuple[Strategy, ...] = BY_STYLE) -> Column:
    """A struct (strategy, authors, coverage, resolved, confidence, needs_review) of a LaTeX front matter."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        rows = [dispatch(t, order) for t in texts.to_pylist()]
        authors = [author for r in rows for author in r.authors]
        ties = _lists([a for _, a in authors], pa.array([x for _, a in authors for x in a], pa.string()))
        listed = _lists([r.authors for r in rows], pa.StructArray.from_arrays([pa.array([n for n, _ in authors], pa.string()), ties], names=["author", "affiliations"]))
        numbers = [pa.array([getattr(r, name) for r in rows], pa.float64()) for name in ("coverage", "resolved", "confidence")]
        review = pa.array([r.confidence < SURE for r in rows], pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r.strategy for r in rows], pa.string()), listed, *numbers, review], names=RESULT.names)

    return run(text)


def tied_authors(rows: DataFrame, key: str, text: str, order: tuple[Strategy, ...] = BY_STYLE) -> DataFrame:
    """(key, author, affiliations): a row for each author that ``dispatched`` finds; only these come back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dispatch(t, order).authors for t in batch.column(1).to_pylist()]
            authors = [author for listed in found for author in listed]
            at = pa.array([k for k, listed in enumerate(found) for _ in listed], pa.int32())
            ties = _lists([a for _, a in authors], pa.array([x for _, a in authors for x in a], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([n for n, _ in authors], pa.string()), ties], names=[key, "author", "affiliations"])

    return rows.select(key, text).mapInArrow(run, StructType([rows.schema[key], *AUTHOR.fields]))
