from collections import Counter

from bibliora.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight; what exceeds a source's limit goes to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full = float(sum(sizes.values())), set()
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / total for s in names}
        full |= set(over)
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)


def test_targets_and_taken_words(documents, corpus):
    taken, _ = mixing.mix_sources(documents)
    rows = taken.collect()
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len((r[1] or "").split())
    expected = targets(sizes)
    assert len(rows) == len(corpus)
    got = Counter()
    for r in rows:
        assert abs(r.target - expected[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r._copies <= 3
        got[r.source] += r._size * r._copies
    largest = {s: max(len((r[1] or "").split()) for r in corpus if r[3] == s) for s in sizes}
    assert all(abs(got[s] - expected[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(documents.repartition(3))[0].collect()))


def test_many_small_documents_come_close_to_the_target(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id % 10 = 0 THEN 'x' WHEN id % 10 < 4 THEN 'y' ELSE NULL END AS source")
    found = mixing.mix_sources(rows)[0].groupBy("source").agg({"target": "max"}).collect()
    words = {r.source: r.words for r in mixing.mix_sources(rows)[0].selectExpr("source", "_size * _copies AS w").groupBy("source").sum("w").toDF("source", "words").collect()}
    assert all(abs(words[r.source] - r["max(target)"]) <= 3 for r in found)


def test_mixed_rows_repeat_and_keep_columns(documents):
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    expected = Counter()
    for r in mixing.mix_sources(documents)[0].collect():
        expected[r.doc_id] += r._copies
    assert Counter(r.doc_id for r in mixed.collect()) == +expected


def test_empty_tables(spark, nothing):
    assert mixing.mix_sources(nothing)[0].isEmpty()
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r._size, r.target) for r in mixing.mix_sources(blank)[0].collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
