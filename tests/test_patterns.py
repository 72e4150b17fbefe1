import re

import pytest
from pyspark.sql import functions as F

from bibliora.operators import patterns

BANK = [
    "high[- ]z", "colou?r", r"\bsup(er)?nova[e]?\b", "gr[ae]y|white dwarf", r"\d{4}", "(?:x|gamma)-rays?", ".", "straße", "İx", "a{2,3}b", "(lens)+ing", r"(\w)\1", "[^a]z$", "^the", "(?=dark)dark (matter|energy)",
    "un(?!bound)b", "k", "s", "µ", "Σ", "[A-Z]{2}[0-9]", "(a|b|)c", "w{0}v", "", "ab*c+d?e", r"Uni\.", "[[]x[]]", "(?i:Q)uasar", "x.{2}y", "(?:GRB|FRB)s?",
]


def pattern_texts():
    import random

    rng = random.Random(6)
    parts = ["high-z", "HIGH z", "color", "Colour", "supernova", "SuperNovae", "grey", "gray ", "white dwarf", "2024", "x-ray", "STRASSE", "straße", "İx", "ıx", "aab", "LENSLENSING", "tt", "bz", "the", "dark energy", "unbound", "unb", "K", "ſ", "μ", "ς", "GW1", "c", "v",
             "abbccde", "Uni.", "[x]", "quasar", "x12y", "FRBs", " ", "\n", "é", "ACE"]
    return [None, ""] + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 7))) for _ in range(400)]


def test_pattern_bank_equals_each_pattern_alone(spark):
    texts = pattern_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    named = patterns.bank(spark, [(p, n) for n, p in enumerate(BANK)])
    found = patterns.pattern_matches(rows, ["t"], named, count=True)
    assert found.columns == ["k", "term", "canonical", "ord", "hits", "column"]
    expected = {(k, p, sum(1 for _ in re.finditer(p, t, re.IGNORECASE))) for k, t in enumerate(texts) if t is not None for p in BANK}
    assert {(r.k, r.term, r.hits) for r in found.collect()} == {e for e in expected if e[2]}
    exact = patterns.pattern_matches(rows, ["t"], named, case_sensitive=True).collect()
    assert {(r.k, r.term) for r in exact} == {(k, p) for k, t in enumerate(texts) if t is not None for p in BANK if re.search(p, t)}


def test_a_bank_of_thousands_equals_rlike(spark):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeghiknorst") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    many = [w[:2] + rng.choice([f"[{w[2]}x]", f"({w[2]}|qq)", w[2] + "?", w[2]]) + w[3:] + rng.choice(["", r"\b", "s?", "[- ]" + rng.choice(words)[:3]]) for w in words]
    rows = spark.createDataFrame([(k, " ".join(rng.choice(words) + rng.choice(["", "s", "-"]) for _ in range(120))) for k in range(60)], "k int, t string")
    named = patterns.bank(spark, [(p, n) for n, p in enumerate(dict.fromkeys(many))])
    found = {(r.k, r.term) for r in patterns.pattern_matches(rows, ["t"], named).collect()}
    alone = rows.crossJoin(named).filter(F.expr("t RLIKE '(?iu)' || term")).select("k", "term").collect()
    assert found == {tuple(r) for r in alone} and len(found) > 1000


def test_patterns_are_tried_on_texts_that_may_match():
    searcher = patterns.Searcher([f"word{k}[ab]?x" for k in range(2000)] + [r"\d"], case_sensitive=False)
    assert list(searcher.matches("a text with Word7x and word1999bX in it", False)) == [(7, 1), (1999, 1), (2000, 1)]
    assert searcher.tried <= 8  # word7, word19, word199, word1999 and those that start with them


def test_required_factors():
    required = patterns.required_factors
    assert required("High[- ]z") == {"high-z", "high z"}
    assert required(r"\bsuper\w*nova") == {"super"}
    assert required("(foo|bar)+baz?") in ({"fooba", "barba"}, {"foo", "bar"})
    assert required("a|") is None and required(".*") is None and required("x*") is None and required("[^a]") is None
    assert required("(ab|[0-9]+)c") == {"c"}


def test_folding_joins_what_matches_without_case():
    for n in range(0x110000):
        c = chr(n)
        for other in {c.lower(), c.upper(), c.swapcase(), c.casefold(), *"ik"} if len(c.lower()) and (n < 0x3000 or 0xA600 < n < 0x10000 or 0x10400 <= n < 0x10600 or 0x1E900 <= n < 0x1EA00) else ():
            if len(other) == 1 and other != c and patterns.folded(other) != patterns.folded(c):
                assert not re.fullmatch(re.escape(other), c, re.IGNORECASE), (c, other)


def test_a_pattern_that_is_none_is_refused(spark):
    rows = spark.createDataFrame([(1, "x")], "k int, t string")
    with pytest.raises(re.error):
        patterns.pattern_matches(rows, ["t"], patterns.bank(spark, [("(", 0)]))
    assert patterns.pattern_matches(rows, ["t"], patterns.bank(spark, [])).isEmpty()
