import numpy as np
import pytest

from bibliora.llm import exact_topk, one_bit_search

BAD = [(900, None), (901, []), (902, [1.0, None, 2.0] + [0.0] * 13), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (None, [1.0] * 16)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(16).round(2).tolist()) for k in range(600)]
    return rows + [(k, rows[7][1]) for k in range(600, 660)] + [(700, [0.0] * 16), (702, [1.0] * 4), (3, rows[3][1]), (100, rows[100][1]), (200, rows[9][1]), (200, rows[11][1])]


@pytest.fixture(scope="module")
def embeddings(spark, vectors):
    return spark.createDataFrame([(k, v, 1) for k, v in vectors + BAD], "vec_id long, embedding array<float>, label int").repartition(5)


def expected(rows, step, k, score):
    out = []
    for q in sorted({q for q, _ in rows if q % step == 0}):
        for v in [min((v for c, v in rows if c == q), key=list)]:
            found = sorted(((-score(v, w), c) for c, w in rows if c != q and len(w) == len(v)))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def test_exact_top_k_equals_brute_force(embeddings, vectors, monkeypatch):
    whole = [(k, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in vectors]
    want = expected(whole, 100, 10, lambda a, b: int(a @ b))
    monkeypatch.setattr(exact_topk, "BUCKETS", 64)
    monkeypatch.setattr(exact_topk, "BLOCK", 3)
    monkeypatch.setattr(exact_topk, "ROWS", 50)
    found = sorted(tuple(r) for r in exact_topk.top_k(embeddings, "vec_id % 100 = 0").collect())
    assert found == want


def test_one_bit_search_finds_nearest(embeddings, vectors):
    usable = [(k, np.array(v, np.float32).astype(float)) for k, v in vectors if any(v)]
    want = expected(usable, 50, 5, lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
    found = sorted(tuple(r) for r in one_bit_search.nearest_neighbours(embeddings, "vec_id % 50 = 0").collect())
    assert len(found) == len(want)
    truth = {(q, c): s for q, _, c, s in want}
    hits = [(q, c, s) for q, _, c, s in found if (q, c) in truth]
    assert len(hits) >= 0.95 * len(want) and all(abs(truth[q, c] - s) < 1e-9 for q, c, s in hits)
    assert all(r[1] >= 1 for r in found)


def test_few_and_no_candidates(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(none, "vec_id % 2 = 0").isEmpty()
    assert one_bit_search.nearest_neighbours(none, "vec_id % 2 = 0").isEmpty()
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.top_k(few, "vec_id = 0").orderBy("rank").collect()] == [(0, 1, 1, 512 * 1024), (0, 2, 2, -1024 * 1024)]
    assert [r.vec_id for r in one_bit_search.nearest_neighbours(few, "vec_id = 0").orderBy("rank").collect()] == [1, 2]


def test_cosines_of_very_small_and_very_large_vectors(spark):
    vectors = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = one_bit_search.nearest_neighbours(table, "vec_id <= 6", 2).collect()
    best = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows}
    assert {q: best[q, 1][0] for q in (1, 2, 3)} == {1: 2, 2: 1, 3: 1} and all(best[q, 1][1] == pytest.approx(1) for q in (1, 2, 3))
    assert best[5, 1] == (4, pytest.approx(2 / 5**0.5)) and best[6, 1] == (1, pytest.approx(3 / 10**0.5)) and len(best) == 12
