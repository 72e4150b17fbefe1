"""Reading LaTeX commands with balanced braces, and plain text from LaTeX."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

#: Commands that go with their arguments, and accents that combine with the letter after them.
DROPPED = ("thanks", "email", "ead", "orcid", "orcidlink", "orcidID", "altaffilmark", "altaffiltext", "footnote", "fnref", "corref", "inst", "aff", "textsuperscript", "label", "correspondingauthor")
ACCENTS = {"'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "l": "ł", "L": "Ł", "i": "i", "aa": "å", "AA": "Å"}

_ACCENT = re.compile(r"\\(['`\"^~=.]|[cvuHkr](?=[\s{]))\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))")
_SIMPLE = re.compile(r"[^\\$%{}~,\s]*(?: [^\\$%{}~,\s]+)*")  # nothing for plain() to do but at its ends
_BRACKETS = {pair: re.compile(rf"(?<!\\)[\{pair[0]}\{pair[1]}]") for pair in ("{}", "[]")}
_OPTION, _ARGUMENT, _COMMENT = re.compile(r"\s*\["), re.compile(r"\s*\{"), re.compile(r"(?<!\\)%[^\n]*")
_MATHS, _BREAK, _COMMAND, _ESCAPED = re.compile(r"\$\s*\^?\s*\{?[^$]*\}?\s*\$"), re.compile(r"\\\\(\[[^\]]*\])?|\\newline\b"), re.compile(r"\\[A-Za-z]+\*?(\[[^\]]*\])?"), re.compile(r"\\([&%_#$])")
_BRACES, _BLANKS, _COMMAS = re.compile(r"[{}]"), re.compile(r"\s+"), re.compile(r"(\s*,)+")
_LETTER = re.compile(r"\\(ss|o|O|ae|AE|l|L|i|aa|AA)(?![A-Za-z])\s?(?:\{\})?")


@dataclass
class Command:
    """A command with its optional and its mandatory argument, and where it ends."""

    name: str
    option: str
    content: str
    start: int
    end: int


def closing(text: str, at: int, pair: str) -> int:
    """The place after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for bracket in _BRACKETS[pair].finditer(text, at):
        depth += 1 if bracket[0] == pair[0] else -1
        if not depth and bracket[0] == pair[1]:
            return bracket.end()
    return len(text)


@cache
def _named(*names: str) -> re.Pattern[str]:
    return re.compile(r"\\(" + "|".join(names) + r")\*?(?![A-Za-z])")


def commands(text: str, *names: str) -> Iterator[Command]:
    """The named commands of a text in order; ``*`` forms count, options may stand before or between arguments."""
    if "\\" not in text:
        return
    for found in _named(*names).finditer(text):
        at, option = found.end(), ""
        while match := _OPTION.match(text, at):
            end = closing(text, match.end() - 1, "[]")
            option = option or text[match.end() : end - 1]
            at = end
        opening = _ARGUMENT.match(text, at)
        if opening:
            end = closing(text, opening.end() - 1, "{}")
            yield Command(found[1], option.strip(), text[opening.end() : end - 1 if text[end - 1 : end] == "}" else end], found.start(), end)


def without_comments(text: str) -> str:
    return _COMMENT.sub("", text) if "%" in text else text


def without(text: str, *names: str) -> str:
    """A text without the named commands and their arguments."""
    if "\\" not in text:
        return text
    for command in reversed(list(commands(text, *names))):
        text = text[: command.start] + text[command.end :]
    return text


def plain(text: str) -> str:
    """Readable text: comments, notes and marks go, accents become letters, other commands leave their content."""
    if _SIMPLE.fullmatch(text):
        return text.strip(" ,;.")
    text = without(without_comments(text), *DROPPED)
    if "\\" in text:
        text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + ACCENTS[m[1]]), text)
        text = _LETTER.sub(lambda m: LETTERS[m[1]], text)
    if "$" in text:
        text = _MATHS.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", _BREAK.sub(", ", text))
        text = _ESCAPED.sub(r"\1", text).replace("\\", " ")
    text = _BLANKS.sub(" ", _BRACES.sub("", text.replace("~", " ")))
    return _COMMAS.sub(",", text).strip(" ,;.")
