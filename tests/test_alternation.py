import random
import re

from bibliora.operators.alternation import Alternation, terms_until_gap

TERMS = [("United States", "US"), ("United", "U"), ("states of", "so"), ("Niger", "NE"), ("Nigeria", "NG"), ("uk", "GB"), ("U.K.", "GB2"), ("UK", "other"), ("Côte d'Ivoire", "CI"), ("a", "A"), ("(x)", "X"), ("", "empty")]


def by_regex(text):
    terms = sorted({t for t, _ in TERMS if t}, key=len, reverse=True)
    names = {}
    for t, n in TERMS:
        names.setdefault(t.lower(), n)
    return [names[m.lower()] for m in re.findall(r"\b(" + "|".join(map(re.escape, terms)) + r")\b", text, re.IGNORECASE)]


def texts(many):
    rng = random.Random(many)
    parts = ["united", " ", "States", " states of", "niger", "ia", "UK", "u.k.", ".", "côte d'ivoire", "é", "a", "(x)", "_", "1", ",", "\t", "Nigeria"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(many)]


def test_alternation_equals_a_regular_expression():
    alternation = Alternation(TERMS)
    for text in texts(6000):
        assert alternation.find(text) == by_regex(text), text
    assert Alternation([]).find("uk") == []


def machine(lines, gap):
    found, since, some = [], 0, False
    for line in lines:
        names = by_regex(line)
        if names:
            some, since = True, 0
            found += names
        elif some:
            since += 1
            if since >= gap:
                break
    return found


def test_lines_until_a_gap(spark):
    rng = random.Random(1)
    rows = []
    for k in range(80):
        lines = [rng.choice(texts(40)) if rng.random() < 0.3 else "nothing here" for _ in range(rng.randrange(30))]
        rows.append((k, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "uk" + "\n-" * 29 + "\nNiger" + "\n-" * 30 + "\nNigeria"), (903, "uk" + "\n" * 31 + "uk")]
    table = spark.createDataFrame(rows, "k int, t string").repartition(3)
    for gap in (1, 3, 30):
        found = {r.k: r.found for r in terms_until_gap(table, "k", "t", TERMS, gap).collect()}
        assert found == {k: machine((t or "").split("\n"), gap) for k, t in rows}
    assert found[902] == ["GB", "NE"] and found[903] == ["GB"]
