"""Authors and affiliations from LaTeX front matter.

One parser reads the commands in order and knows how styles tie authors to affiliations: by marks (options, numbers
in superscript, ``\\inst``, ``\\altaffilmark``) or by order (an affiliation belongs to the authors since the last one).
Affiliations may also stand under the names in the author argument, or in boxes of their own, each led by its mark.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from ..functions import latex

AUTHOR = StructType([StructField("author", StringType()), StructField("affiliations", ArrayType(StringType()))])
RESULT = StructType([StructField("authors", ArrayType(AUTHOR)), StructField("confidence", DoubleType()), StructField("needs_review", BooleanType())])
#: How sure each way of tying is, and from where a result needs no review.
BY_MARKS, BY_ORDER, UNTIED, SURE = 0.95, 0.75, 0.2, 0.8

_MARK = re.compile(r"\$\s*\^\s*(\{[^$]*\}|[^$\s])\s*\$|\\(?:textsuperscript|altaffilmark|inst|aff)\s*\{([^}]*)\}")
_LEAD = re.compile(r"\s*(?:\$\s*\^\s*\{?(\w+)\}?\s*\$|\\textsuperscript\{(\w+)\})")
_LINE_END, _MARKS_APART, _NO_WORD, _NO_NAME, _AND_FIRST = re.compile(r"\\\\(?:\[[^\]]*\])?"), re.compile(r"[,;\s]+"), re.compile(r"[^\w]"), re.compile(r"[\W\d]+"), re.compile(r"^(and\s+)+")
_BETWEEN = re.compile(r"\\and\b|\\AND\b|\\newauthor\b|(?<=\$),(?!\s*\$)|(?<=\}),(?=[^{}]*(?:\{[^{}]*\}[^{}]*)*$)|\band\b")
_COMMA_OUTSIDE = re.compile(r",(?![^{]*\})")
_COMMA_BEFORE_MARK = re.compile(r"(?<![$}\s]),\s*(\$\s*\^\s*(?:\{[^$]*\}|[^$\s])\s*\$)")


def _boxes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, content) of the ``\\parbox{width}{content}`` of a text."""
    found = []
    for box in latex.commands(text, "parbox") if "\\parbox" in text else ():
        if opening := re.compile(r"\s*\{").match(text, box.end):
            end = latex.closing(text, opening.end() - 1, "{}")
            found.append((box.start, end, text[opening.end() : end - 1]))
    return found


def _unboxed(text: str) -> str:
    """A text with boxes replaced by their content, each on a line of its own, and without spacing."""
    for start, end, content in reversed(_boxes(text)):
        text = f"{text[:start]}{content}\\\\{text[end:]}"
    return latex.without(text, "vspace", "hspace")


def _lines_apart(content: str) -> tuple[str, dict[str, str]]:
    """The names in an author argument, and the affiliations under them by the marks that lead their lines."""
    names, marked = [], {}
    for line in _LINE_END.split(content):
        lead = _LEAD.match(line)
        name = latex.plain(line[lead.end() :]) if lead else ""
        if name:
            marked.setdefault(lead[1] or lead[2], name)
        else:
            names.append(line)
    return (" ".join(names), marked) if marked else (content, {})


def _marks(text: str) -> list[str]:
    found = []
    for match in _MARK.finditer(latex.without(text, "orcidlink", "orcid", "thanks", "email")):
        found += [_NO_WORD.sub("", m) for m in _MARKS_APART.split((match[1] or match[2] or "").strip("{}"))]
    return [m for m in found if m]


def _names(content: str) -> list[tuple[str, list[str]]]:
    """The names in an author argument, with the marks of each."""
    if "$" in content:
        content = _COMMA_BEFORE_MARK.sub(r"\1,", content)
    pieces = _BETWEEN.split(content)
    if not _MARK.search(content):
        pieces = [p for piece in pieces for p in _COMMA_OUTSIDE.split(piece)]
    found = []
    for piece in pieces:
        name = _AND_FIRST.sub("", latex.plain(_MARK.sub(" ", piece)))
        if name and not _NO_NAME.fullmatch(name):
            found.append((name, _marks(piece)))
    return found


def parse(text: str | None) -> tuple[list[tuple[str, list[str]]], float]:
    """[(author, [affiliations])] of a front matter and how sure they are."""
    text = latex.without_comments(text or "")
    authors: list[tuple[str, list[str]]] = []
    marked: dict[str, str] = {}
    in_order: list[tuple[int, str]] = []  # how many authors there were, and the affiliation that came then
    for command in latex.commands(text, "author", "affiliation", "affil", "address", "institute", "altaffiltext", "institution"):
        if command.name == "author":
            labels = [x.strip() for x in command.option.split(",") if x.strip()]
            content, under = _lines_apart(_unboxed(command.content))
            marked |= under
            authors += [(name, labels + marks) for name, marks in _names(content)]
        elif command.name == "institute":
            for number, part in enumerate(re.split(r"\\and\b", command.content), 1):
                if name := latex.plain(part):
                    marked[str(number)] = name
        elif command.name == "altaffiltext":
            rest = re.compile(r"\s*\{").match(text, command.end)
            if rest:
                marked[command.content.strip()] = latex.plain(text[rest.end() : latex.closing(text, rest.end() - 1, "{}") - 1])
        else:
            lead = _LEAD.match(command.content)
            name = latex.plain(command.content[lead.end() :] if lead else command.content)
            label = command.option or (lead and (lead[1] or lead[2])) or ""
            if label and name:
                marked[label] = name
            elif name:
                in_order.append((len(authors), name))
    if not authors and (boxes := [content for _, _, content in _boxes(text)]):
        content, under = _lines_apart(latex.without("\\\\".join(boxes), "vspace", "hspace"))
        marked |= under
        authors = _names(content)
    if not marked:  # blocks of numbered lines after the authors
        for match in re.finditer(r"(?m)^\s*\$\s*\^\s*\{?(\w+)\}?\s*\$\s*([^\n]+)$", text):
            if name := latex.plain(match[2]):
                marked.setdefault(match[1], name)
    found: list[tuple[str, list[str]]] = [(name, [marked[m] for m in marks if m in marked]) for name, marks in authors]
    sure = BY_MARKS if marked and any(a for _, a in found) else UNTIED
    if in_order and not marked:
        for many, name in in_order:
            for k in range(_last_group(in_order, many), many):
                found[k][1].append(name)
        sure = BY_ORDER if any(a for _, a in found) else UNTIED
    every = list(dict.fromkeys([*marked.values(), *(n for _, n in in_order)]))
    if len(every) == 1:
        found = [(name, a or every) for name, a in found]
        sure = max(sure, BY_ORDER)
    return [(name, list(dict.fromkeys(a))) for name, a in found], sure if found else 0.0


def _last_group(in_order: list[tuple[int, str]], many: int) -> int:
    """The first author of the group that ends with author number ``many``."""
    return max((m for m, _ in in_order if m < many), default=0)


@F.pandas_udf(RESULT)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    rows = [parse(t) for t in texts]
    return pd.DataFrame({
        "authors": [[{"author": n, "affiliations": a} for n, a in authors] for authors, _ in rows],
        "confidence": [sure for _, sure in rows],
        "needs_review": [sure < SURE for _, sure in rows],
    })


def affiliations(text: Column) -> Column:
    """A struct (authors, confidence, needs_review) of a LaTeX front matter."""
    return _parsed(text)


def fill_affiliations(papers: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Papers with holes in ``affiliations`` filled from parsed rows (key, author, affiliations).

    ``authors`` and ``affiliations`` are parallel lists. A hole takes the affiliations of the matching parsed author,
    joined by semicolons; a collaboration or team takes the first known one; and if the paper then has exactly one
    different affiliation, it goes to all holes.
    """
    from .matching import name_matches

    slots = papers.select(key, F.posexplode("authors").alias("_slot", "_author"))
    left = slots.select(F.struct(key, "_slot").alias("_left"), F.col(key).alias("_k"), F.col("_author").alias("_n"))
    right = parsed.select(F.col(key).alias("_rk"), F.array_join("affiliations", "; ").alias("_found"), F.col("author").alias("_n"))
    pairs = name_matches(left, right, "_n").filter("_k = _rk AND _found <> ''")
    found = pairs.groupBy("_left").agg(F.min("_found").alias("_found")).select(F.col(f"_left.{key}").alias(key), F.col("_left._slot").alias("_slot"), "_found")
    lists = slots.join(found, [key, "_slot"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_slot", "_found"))).alias("_all"))
    rows = papers.join(lists, key, "left")
    known = F.transform("authors", lambda a, k: F.coalesce(F.get("affiliations", k), F.get("_all", k)["_found"]))
    rows = rows.withColumn("_known", known)
    first = F.get(F.array_compact("_known"), F.lit(0))
    team = F.transform("authors", lambda a, k: F.coalesce(F.get("_known", k), F.when(F.lower(a).rlike(r"\b(collaboration|team)\b"), first)))
    rows = rows.withColumn("_known", team)
    single = F.size(F.array_distinct(F.array_compact("_known"))) == 1
    only = F.get(F.array_compact("_known"), F.lit(0))
    return rows.withColumn("affiliations", F.transform("_known", lambda x: F.coalesce(x, F.when(single, only)))).drop("_known", "_all")
