import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size string, p int"


def words(rng, many, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(many))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows; two extra columns."""
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 70)
    texts = [None, "", " \t\n", "one", "Two words", "three small words", base, base, base.upper().lower()]
    texts += [" ".join(w if rng.random() > 0.01 else "changed" for w in base.split()) for _ in range(25)]
    texts += [" ".join(w if rng.random() > 0.06 else f"x{rng.randrange(99)}" for w in base.split()) for _ in range(25)]
    texts += [f"{words(rng, 40)} {passage} {words(rng, rng.randrange(60))}" for _ in range(20)]
    texts += [words(rng, rng.randrange(1, 150)) for _ in range(40)] + [words(rng, 30_000, 50), "same " * 400]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 9 else None, len(t or ""), "extra", 1) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20]]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
