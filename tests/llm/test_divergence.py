import random
import re
from collections import Counter, defaultdict

from bibliora.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_force(documents, most=200):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in documents:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        counts = {s: c for (own, s), c in groups.items() if own == lang}
        whole = Counter()
        for c in counts.values():
            whole.update({t: c[t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, end in (("pair", pairs, None), ("term", terms, most)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:end]
                found += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(rows, 1)]
    return sorted(found)


def test_rows_equal_brute_force(documents, corpus):
    rows = divergence.audit(documents, most=50)
    assert rows.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, rows.collect())) == brute_force([(r[1], r[2], r[3]) for r in corpus], 50)


def test_many_sources_accents_ties_and_single_sources(spark):
    rng = random.Random(4)
    letters = ["Été", "été", "ÉTÉ", "naïve", "漢字", "x1y", "Zeta"] + [f"t{chr(97 + k)}" for k in range(26)]
    rows = [(" ".join(rng.choice(letters[: rng.randrange(1, len(letters))]) for _ in range(rng.randrange(40))), rng.choice(["fr", "", None]), f"s{rng.randrange(12)}") for _ in range(300)]
    rows += [("one two", "it", "only"), ("one", "it", "only"), (None, "de", "a"), ("", "de", "b"), ("w w w", "sv", "a"), ("w w w", "sv", "a"), ("w", "sv", None), ("w", "sv", "")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(4)
    found = sorted(map(tuple, divergence.audit(table).collect()))
    assert found == brute_force(rows)
    assert [r for r in found if r[0] == "de"] == [("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)]
    assert not [r for r in found if r[0] == "it" and r[2] == "pair"]


def test_nothing(nothing):
    assert divergence.audit(nothing).isEmpty()


def test_shares_of_large_counts_are_exact(spark):
    cases = [(0, 0, 1), (5, 9, 4), (10**13, 3 * 10**13 + 7, 10**8), (123_456_789_012, 987_654_321_098, 77)]
    for c, n, v in cases:
        assert spark.sql(f"SELECT {divergence._share(f'{c}L', f'{n + v}L')} AS p").first().p == 1 + 10**9 * (c + 1) // (n + v)
