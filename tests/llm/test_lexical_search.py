import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bibliora.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string, key string, score long"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(documents, items, k=10):
    counted = [(key, Counter(terms(text))) for key, text in documents]
    counted = [(key, c) for key, c in counted if c]
    total, length, df = len(counted), sum(c.total() for _, c in counted), Counter(t for _, c in counted for t in c)
    found = []
    for item, text in items:
        scores = []
        for key, c in counted:
            m = 10 + 90 * c.total() * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scores += [(-score, key is None, key, score)] if score > 0 else []
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        found += [(item, rank, s[2], s[3]) for rank, s in enumerate(best, 1)]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def asked(corpus):
    rng = random.Random(8)
    texts = [corpus[6][1], corpus[60][1][:400], "w1 W2 w3 w3", None, "", "--- !", "same", "notthere", "Été été Ét"]
    texts += [" ".join(rng.choice(corpus)[1:2][0] or "" for _ in range(2))[:300] for _ in range(12)]
    return list(enumerate(texts)) + [(2, "w1 W2 w3 w3")]


def test_rows_equal_brute_force(spark, documents, corpus, asked, monkeypatch):
    expected = brute_force([r[:2] for r in corpus], asked)
    for shard, fan in ((lexical_search.SHARD_DOCUMENTS, 32), (7, 2), (1000, 3)):
        monkeypatch.setattr(lexical_search, "SHARD_DOCUMENTS", shard)
        monkeypatch.setattr(lexical_search, "FAN", fan)
        rows = lexical_search.rank(documents, spark.createDataFrame([(i, t, "x", 1) for i, t in asked], ITEMS)).collect()
        assert sorted(map(tuple, rows), key=str) == expected


def test_blocks_of_items_give_the_same(spark, documents, corpus, asked, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 60)
    rows = lexical_search.rank(documents, spark.createDataFrame(asked, "item_id long, text string"), k=3).collect()
    assert sorted(map(tuple, rows), key=str) == brute_force([r[:2] for r in corpus], asked, 3)


def test_ties_nulls_and_nothing(spark, nothing):
    texts = [(9, "a b"), (3, "a b"), (None, "a b"), (4, "A, B!"), (3, "a b"), (5, None), (6, "...")] + [(100 + k, "c") for k in range(4)]
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "a"), (2, "zzz")], "item_id long, text string")
    assert sorted(map(tuple, lexical_search.rank(documents, items).collect()), key=str) == brute_force(texts, [(1, "a"), (2, "zzz")])
    assert [r.doc_id for r in lexical_search.rank(documents, items, k=3).orderBy("rank").collect()] == [3, 3, 4]
    assert lexical_search.rank(nothing, items).isEmpty() and lexical_search.rank(documents, items.limit(0)).isEmpty()


def random_tree(rng, many, width):
    document = np.sort(rng.integers(0, many, many * 4))
    term = rng.integers(0, width, many * 4)
    pairs = np.unique(document * width + term)
    addend = rng.integers(1, 1000, len(pairs))
    return lexical_search.Tree(rng.permutation(many), pairs // width, pairs % width, addend, width), pairs, addend


def test_few_ranges_are_opened_and_none_too_few():
    rng = np.random.default_rng(1)
    many, width = 20_000, 50
    tree, pairs, addend = random_tree(rng, many, width)
    strong = np.flatnonzero(pairs // width == 777)
    for asked in ([3], [3, 8], list(range(10))):
        scores = np.zeros(many, np.int64)
        inside = np.isin(pairs % width, asked)
        np.add.at(scores, (pairs // width)[inside], addend[inside])
        order = np.lexsort((tree.keys, -scores))[:10]
        best = lexical_search.Best(10, np.empty(0, np.int64), np.empty(0, np.int64))
        opened = lexical_search.search_tree(tree, np.array(asked), best)
        assert best.scores.tolist() == scores[order].tolist() and best.keys.tolist() == tree.keys[order].tolist()
        assert opened <= many // lexical_search.FAN + many // lexical_search.FAN**2 + 2
    addend[strong] = 100_000  # one document far ahead: a tree is opened along one path
    term = pairs % width
    tree = lexical_search.Tree(tree.keys, pairs // width, term, addend, width)
    best = lexical_search.Best(1, np.empty(0, np.int64), np.empty(0, np.int64))
    assert lexical_search.search_tree(tree, np.unique(term[strong])[:1], best) == len(tree.levels)
    assert best.keys.tolist() == [tree.keys[777]]


def test_addends_beyond_64_bit_products():
    n = np.array([5, 10**7])
    found = lexical_search.addends(np.array([0, 0]), np.array([1, 3]), n, np.array([7]), 10**12, 10**15 + 1)
    assert found.tolist() == [7 * (10**9 * c // (1000 * c + 8 * (10 + 90 * x * 10**12 // (10**15 + 1)))) for c, x in zip([1, 3], n.tolist(), strict=True)]
