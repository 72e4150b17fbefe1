"""Normal forms of countries, institutions and venues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import mapped

#: Other names of countries.
COUNTRY_ALIASES = {
    "USA": "United States",
    "UK": "United Kingdom",
    "UAE": "United Arab Emirates",
    "United States of America": "United States",
    "People's Republic of China": "China",
    "The Netherlands": "Netherlands",
    "Republic of Korea": "South Korea",
    "The United Kingdom": "United Kingdom",
}
#: What names a country in lower-case affiliations, in order of precedence.
COUNTRY_WORDS = {
    "usa": "United States",
    "united states": "United States",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "china": "China",
    "people's republic of china": "China",
    "germany": "Germany",
    "france": "France",
    "italy": "Italy",
    "india": "India",
    "japan": "Japan",
    "canada": "Canada",
    "australia": "Australia",
    "spain": "Spain",
    "russia": "Russia",
    "brazil": "Brazil",
    "south korea": "South Korea",
    "switzerland": "Switzerland",
    "netherlands": "Netherlands",
    "sweden": "Sweden",
    "taiwan": "Taiwan",
    "israel": "Israel",
    "austria": "Austria",
    "denmark": "Denmark",
    "belgium": "Belgium",
    "finland": "Finland",
    "norway": "Norway",
    "poland": "Poland",
    "mexico": "Mexico",
    "chile": "Chile",
    "argentina": "Argentina",
    "czech republic": "Czech Republic",
    "turkey": "Turkey",
    "greece": "Greece",
    "portugal": "Portugal",
    "singapore": "Singapore",
    "south africa": "South Africa",
    "hong kong": "Hong Kong",
    "new zealand": "New Zealand",
    "ireland": "Ireland",
    "hungary": "Hungary",
    "colombia": "Colombia",
}
#: Families of venues by what their names contain, in order of precedence.
VENUE_FAMILIES = {"ApJ": ("apj", "astrophysical journal"), "MNRAS": ("mnras", "monthly notices"), "A&A": ("a&a", "astronomy and astrophysics", "astronomy & astrophysics")}
#: Words that mark the part of an affiliation that names the institution.
INSTITUTION_WORDS = ("university", "institute", "institut", "college", "observatory", "laboratory", "lab", "academy", "school", "center", "centre")


def last_part(affiliation: Column) -> Column:
    """What follows the last comma, without closing quotes, brackets and stops; null stays null."""
    return F.trim(F.rtrim(F.substring_index(affiliation, ",", -1), F.lit("']\".")))


def known_countries(dimension: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The names of a country dimension, longest first; a dimension of more than ``most`` is refused."""
    names = [r[0] for r in dimension.select(column).dropna().distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} countries")
    return sorted(names, key=lambda n: (-len(n), n))


def country(affiliation: Column, known: list[str]) -> Column:
    """The country of an affiliation: the last part through the aliases, the last part if it is a country, or a
    country (in any case) at the end of the text, the longest first. Otherwise null."""
    last = last_part(affiliation)
    alias = F.when(last.isin(*COUNTRY_ALIASES), mapped(last, COUNTRY_ALIASES))
    exact = F.when(last.isin(*known), last)
    by_lower = {n.lower(): n for n in reversed(known)}
    ending = F.regexp_extract(F.lower(affiliation), r"\b(" + "|".join(re.escape(n.lower()) for n in known) + r")\W*$", 1)
    return F.coalesce(alias, exact, F.when(ending != "", mapped(ending, by_lower)))


def first_filled(*lists: Column) -> Column:
    """The first list that is there and not empty, else an empty one."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


def institutions(text: Column) -> Column:
    """The institutions of ``author: affiliation; affiliation`` text: of each affiliation the first comma part with an
    institution word, or else the first; bracketed text and what follows a slash or backslash goes."""
    word = r"(?i)\b(" + "|".join(INSTITUTION_WORDS) + r")\b"

    def one(part: Column) -> Column:
        pieces = F.transform(F.split(part, ","), lambda x: F.trim(x))
        named = F.filter(pieces, lambda x: x.rlike(word))
        chosen = F.coalesce(F.get(named, F.lit(0)), F.get(pieces, F.lit(0)))
        return F.trim(F.regexp_replace(F.regexp_replace(chosen, r"\[[^\]]*\]|\([^)]*\)", " "), r"[\\/].*$", ""))

    bare = F.transform(F.split(text, ";"), lambda x: F.regexp_replace(x, r"^[^:]*:", ""))
    return F.filter(F.transform(bare, one), lambda x: x != "")


def flag(published: Column, comments: Column, journals: Column, *words: str) -> Column:
    """1 if a paper is in a journal: it names one, its comments say so (any of the words), or the journal list has it."""
    said = F.lit(False)
    for w in words:
        said = said | F.coalesce(F.lower(comments).contains(w), F.lit(False))
    return F.when(published.isNotNull() | said | journals.isNotNull(), 1).otherwise(0)


def exact_venue(venue: Column, labels: dict[str, str], families: dict[str, str], otherwise: str = "Unknown") -> Column:
    """The label of a venue: what stands before the first comma, without digits, in an exact table; else the last family
    whose key it has, in any case; else ``otherwise``. Null stays null."""
    key = F.trim(F.regexp_replace(F.substring_index(venue, ",", 1), r"\d+", ""))
    family = F.lit(None).cast("string")
    for part, label in families.items():
        family = F.when(F.lower(key).contains(part.lower()), F.lit(label)).otherwise(family)
    exact = F.when(key.isin(*labels), mapped(key, labels))
    return F.when(venue.isNotNull(), F.coalesce(exact, family, F.lit(otherwise)))


def country_of_parts(affiliation: Column, names: dict[str, str] = COUNTRY_WORDS) -> Column:
    """The country of the last comma part that is a name, letters and spaces only; else of the first name in order that
    occurs anywhere, also inside words. Otherwise null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    lower = F.lower(affiliation)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z\s]", ""), r"^\s+|\s+$", "")
    whole = F.array_compact(F.transform(F.split(lower, ","), lambda x: F.try_element_at(table, bare(x))))
    inside = F.coalesce(*[F.when(lower.contains(name), F.lit(country)) for name, country in names.items()])
    return F.coalesce(F.get(whole, F.size(whole) - 1), inside)


def countries_of_parts(affiliations: Column, names: dict[str, str] = COUNTRY_WORDS) -> Column:
    """The distinct countries of affiliations parted by semicolons, in order; null has none."""
    found = F.array_distinct(F.array_compact(F.transform(F.split(affiliations, ";"), lambda x: country_of_parts(x, names))))
    return F.coalesce(found, F.array().cast("array<string>"))


def venue_family(venue: Column, families: dict[str, tuple[str, ...]] = VENUE_FAMILIES) -> Column:
    """The first family of which a venue has a word, in any case; else null."""
    lower = F.lower(venue)
    return F.coalesce(*[F.when(F.greatest(*[lower.contains(w) for w in words], F.lit(False)), F.lit(label)) for label, words in families.items()])


def affiliation_by_surname(author: Column, authors: Column, affiliations: Column) -> Column:
    """The affiliation of the first of ``authors`` (``Last, First``) with the surname of ``author`` (``First Last``); of
    a single author the only one. Null if there is none, if it is a dash or if the author is empty."""
    words = F.filter(F.split(F.replace(author, F.lit("."), F.lit(" ")), r"\s+"), lambda x: x != "")
    surname = F.lower(F.get(words, F.size(words) - 1))
    surnames = F.transform(authors, lambda x: F.trim(F.lower(F.substring_index(x, ",", 1))))
    at = F.array_position(surnames, surname)
    found = F.when(at > 0, F.get(affiliations, (at - 1).cast("int"))).when(surname.isNotNull() & (F.size(authors) == 1), F.get(affiliations, F.lit(0)))
    return F.nullif(found, F.lit("-"))
