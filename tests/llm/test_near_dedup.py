import random

import numpy as np
import pytest

from bibliora.llm import components, near_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_force(rows, n):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(documents, corpus, n):
    found = near_dedup.near_duplicate_groups(documents, n=n).collect()
    expected = brute_force(corpus, n)
    assert len(found) == len(corpus)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)


def test_small_blocks_find_the_same_links(documents, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    found = near_dedup.near_duplicate_groups(documents, n=4).collect()
    expected = brute_force(corpus, 4)
    assert all(r.component_id == expected[r.doc_id][1] for r in found)


def test_empty_table_and_null_ids(spark, nothing):
    assert near_dedup.near_duplicate_groups(nothing).isEmpty()
    rows = near_dedup.near_duplicate_groups(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 2, True)} or {(r.doc_id, r.kept) for r in rows} == {(None, True), (1, True), (2, True)}


def test_signatures_estimate_similarity_with_less_variance_than_minhash():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a, b = pool[:60], pool[30:]
        s = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, 60, 120]))
        errors.append((s[0] == s[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < (1 / 3) * (2 / 3) / near_dedup.REGISTERS


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components.component_roots(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert found == {x: find(x) for x in list(root) if find(x) != x}
