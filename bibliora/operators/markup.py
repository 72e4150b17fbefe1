"""Extraction from HTML by structure: paths of steps, followed in one pass over a page.

A page is read tag by tag with a stack of open elements. Each path is a chain of steps; what is left to match is carried
on the stack, so that no tree is built. Texts are spans of the text read so far.

Pages may be malformed: end tags that HTML lets authors omit are supplied, end tags without an open element are passed
over, elements still open at the end are closed there. Scripts and styles have no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, and the open elements that a start tag ends when their end tag is left out.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
    "p": ("p",), "div": ("p",), "ul": ("p",), "ol": ("p",), "dl": ("p",), "table": ("p",), "blockquote": ("p",), "article": ("p",), "section": ("p",), "nav": ("p",), "footer": ("p",), "header": ("p",),
    "pre": ("p",), "form": ("p",), "hr": ("p",), "h1": ("p",), "h2": ("p",), "h3": ("p",), "h4": ("p",), "h5": ("p",), "h6": ("p",),
}
#: Fixed values of HTML: elements beyond which no start tag ends an open one.
HOLDS = frozenset(("html", "body", "table", "td", "th", "ul", "ol", "dl", "div", "article", "section", "nav", "blockquote", "form", "button"))
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_HITS = "_hits array<struct<path: int, record: int, text: string, value: string>>"


def closed_references(page: str) -> str:
    """A page in which only character references with their semicolon count; any other "&" stays as it is written."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], page)


class Step(NamedTuple):
    """An element: its tag, classes that it has, attributes with their values, and its whole text.

    ``relation`` to the element of the step before: "inside" it at any depth, "child" of it, the first later "sibling" of it
    that fits, or its "parent" (which has to fit as well).
    """

    tag: str | None = None
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str], ...] = ()
    text: str | None = None
    relation: str = "inside"

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        if self.classes and not set(self.classes) <= set(attributes.get("class", "").split()):
            return False
        return all(attributes.get(name) == value for name, value in self.attributes)


Path = tuple[Step, ...]


class _Open:
    """An open element: what may match below it and after it, and what it has matched itself."""

    __slots__ = ("after", "attributes", "below", "child", "mine", "order", "record", "start", "tag", "up")

    def __init__(self, tag: str, attributes: dict[str, str], start: int, order: int, record: int, below: list[tuple[int, int]]) -> None:
        self.tag, self.attributes, self.start, self.order, self.record = tag, attributes, start, order, record
        self.below, self.child, self.after = below, [], []  # steps for elements inside, for children, for later children
        self.mine: list[tuple[int, int]] = []  # steps that this element has matched but for its text
        self.up: list[tuple[int, int]] = []  # steps that name this element the parent of a match


class PageReader(HTMLParser):
    """Reads a page and gathers (path, record, text, value) of the elements that match whole paths, in order of their start.

    ``record``: how many elements have matched ``records`` before or at the element's start, less one; without records 0.
    ``value``: the attribute ``attribute`` of the element.
    """

    def __init__(self, paths: Sequence[Path], attribute: str, records: Path | None) -> None:
        super().__init__(convert_charrefs=True)
        for path in [*paths, *([records] if records else [])]:
            if path[0].relation != "inside" or any(a.text is not None and b.relation in ("inside", "child") for a, b in zip(path, path[1:], strict=False)):
                raise ValueError("a path starts inside the page, and what is in an element cannot depend on its whole text")
        self.paths, self.attribute = [*paths, records] if records else list(paths), attribute
        self.marker = len(paths) if records else -1

    def read(self, page: str) -> list[tuple[int, int, str, str | None]]:
        self.reset()
        self.text: list[str] = []
        self.count, self.silent = 0, 0
        self.record = -1 if self.marker >= 0 else 0
        self.found: list[tuple[int, int, int, str, str | None]] = []
        self.stack = [_Open("", {}, 0, 0, 0, [(p, 0) for p in range(len(self.paths))])]
        self.feed(page)
        self.close()
        while len(self.stack) > 1:
            self._end()
        return [hit[1:] for hit in sorted(self.found, key=lambda h: h[:2])]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = ENDED_BY.get(tag)
        if ended:
            depth = len(self.stack)
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in ended:
                    depth = at
                elif self.stack[at].tag in HOLDS:
                    break
            while len(self.stack) > depth:
                self._end()
        above = self.stack[-1]
        attributes = {name: value or "" for name, value in reversed(attrs)}  # of an attribute given twice the first counts
        self.count += 1
        own = _Open(tag, attributes, len(self.text), self.count, self.record, above.below)
        fits = lambda states: [(p, s) for p, s in states if self.paths[p][s].fits(tag, attributes)]
        matched = fits(above.below) + fits(above.child)
        if above.after:
            here = fits(above.after)
            above.after = [state for state in above.after if state not in here]
            matched += here
        self.stack.append(own)
        for path, step in dict.fromkeys(matched):
            own.mine.append((path, step))
            if self.paths[path][step].text is None:
                self._go_on(own, above, path, step, start=True)
        if tag in ("script", "style"):
            self.silent += 1
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML but for elements that are void anyway

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                while len(self.stack) > at:
                    self._end()
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)

    def _go_on(self, own: _Open, above: _Open, path: int, step: int, start: bool) -> None:
        """A step has matched: expect the next one."""
        if step + 1 == len(self.paths[path]):
            if path == self.marker and start:
                self.record += 1
                own.record = self.record
            return
        relation = self.paths[path][step + 1].relation
        if relation == "inside":
            own.below = [*own.below, (path, step + 1)]
        elif relation == "child":
            own.child.append((path, step + 1))
        elif relation == "sibling":
            above.after.append((path, step + 1))
        elif self.paths[path][step + 1].fits(above.tag, above.attributes):
            above.up.append((path, step + 1))

    def _end(self) -> None:
        own = self.stack.pop()
        above = self.stack[-1]
        if own.tag in ("script", "style"):
            self.silent -= 1
        if own.mine or own.up:
            text = " ".join("".join(self.text[own.start :]).split())
            for path, step in dict.fromkeys(own.mine + own.up):
                wanted = self.paths[path][step].text
                if wanted not in (None, text):
                    continue
                if wanted is not None or (path, step) in own.up:
                    self._go_on(own, above, path, step, start=False)
                if step + 1 == len(self.paths[path]) and path != self.marker:
                    self.found.append((own.order, path, own.record, text, own.attributes.get(self.attribute)))


def extracted(pages: DataFrame, html: str, fields: dict[str, Sequence[Path]], attribute: str = "href", records: Path | None = None, closed: bool = False) -> DataFrame:
    """A row for each page, or for each record of a page, with an array of (text, value) for each field.

    A field is a chain of paths: the first that matches anything fills it, the others are fallbacks; a field that none
    fills is an empty array. With ``records`` a page has a row, numbered in ``record`` from 0, for each element of that
    path, which holds what starts at it or after it and before the next; pages without one have no rows. Null pages are
    empty pages. Other columns of ``pages`` are kept. HTML reads "&amp" like "&amp;"; with ``closed`` a reference needs its
    semicolon, so that one that was cut off stays as it is written.
    """
    chains = [(name, path) for name, paths in fields.items() for path in paths]
    paths = [path for _, path in chains]
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(paths, attribute, records)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hits, many = [], []
                for page in part.column(len(kept)):
                    hits.append([dict(zip(("path", "record", "text", "value"), hit, strict=True)) for hit in reader.read(closed_references(page.as_py() or "") if closed else page.as_py() or "")])
                    many.append(reader.record + 1 if records else 1)
                kind = pa.list_(pa.struct([("path", pa.int32()), ("record", pa.int32()), ("text", pa.string()), ("value", pa.string())]))
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, pa.array(hits, kind), pa.array(many, pa.int32())], names=[*kept, "_hits", "_records"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(kept).schema.fields), _HITS, "_records int"])
    found = pages.select(*kept, html).mapInArrow(run, schema)
    if records:
        found = found.select("*", F.explode(F.expr("CASE WHEN _records > 0 THEN sequence(0, _records - 1) ELSE array() END")).alias("record"))
        found = found.withColumn("_hits", F.expr("filter(_hits, h -> h.record = record)"))

    def field(name: str) -> Column:
        filled = [F.expr(f"transform(filter(_hits, h -> h.path = {n}), h -> struct(h.text AS text, h.value AS value))") for n, (own, _) in enumerate(chains) if own == name]
        chosen = filled[-1]
        for earlier in reversed(filled[:-1]):
            chosen = F.when(F.size(earlier) > 0, earlier).otherwise(chosen)
        return chosen.alias(name)

    return found.select(*kept, *(["record"] if records else []), *map(field, fields))
