import random

import numpy as np
from pyspark.sql import functions as F

from bibliora.llm import language_id, linear, quality


def make(spark, many=240):
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["qué", "ñor", "ción"]}
    rows, labels = [], []
    for k in range(many):
        lang = ("aa", "bb", "cc")[k % 3]
        bad = k % 5 == 0
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) + ("!!" if bad else "") for _ in range(60))
        rows.append((k, text.upper() if bad else text, lang, f"s{k % 4}", len(text)))
        if k % 4:
            labels.append((k, 0 if bad else 1, 0))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_unlabelled_documents(spark):
    documents, labels = make(spark)
    model = quality.co_train(documents, labels)
    rows = quality.score(documents, model).collect()
    assert len(rows) == 240 and all(r.keep == (r.doc_id % 5 != 0) and 0 <= r.score <= 1 for r in rows)
    kept = quality.without_low_quality(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {k for k in range(240) if k % 5}
    again = quality.score(documents.repartition(7), quality.co_train(documents.repartition(3), labels)).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in again) == sorted((r.doc_id, round(r.score, 6)) for r in rows)


def test_quality_of_a_rare_kind_of_label(spark, monkeypatch):
    documents, _ = make(spark, 600)
    bad = [k for k in range(0, 600, 5)]
    last = linear.hash_order(F.col("doc_id")).desc()  # far from the first in hash order
    low = [r.doc_id for r in documents.filter("doc_id % 5 = 0").orderBy(last).limit(5).collect()]
    labels = spark.createDataFrame([(k, 1) for k in range(600) if k % 5] + [(k, 0) for k in low], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE", 50)
    model = quality.co_train(documents, labels)
    assert model is not None
    chances = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    assert np.mean([chances[k] for k in bad]) < np.mean([chances[k] for k in chances if k % 5])


def test_quality_exchanges_the_surest_of_all_unlabelled_documents(spark):
    documents, labels = make(spark, 300)
    rows = documents.select(*quality.COLUMNS).withColumn("_row", F.xxhash64(*quality.COLUMNS))
    sample = documents.join(labels.filter("doc_id < 100"), "doc_id").orderBy("doc_id").collect()
    truth = np.array([r.quality for r in sample])
    weights = [20 * linear.follow_the_leader(v, truth, 2) for v in quality._views(sample)]
    known = labels.filter("doc_id < 100")
    free = rows.join(known, "doc_id", "left_anti").orderBy(linear.hash_order(F.col("doc_id"))).collect()
    taken, expected = set(), []
    odds = [(v * (w[:, 1] - w[:, 0])).sum(axis=1) for v, w in zip(quality._views(free), weights, strict=True)]
    for giver in (0, 1):
        for label, many in ((1, 7), (0, 3)):
            sure = odds[giver] if label else -odds[giver]
            best = [k for k in np.argsort(-sure, kind="stable") if k not in taken and sure[k] >= np.log(19)][:many]
            taken |= set(best)
            expected.append((1 - giver, label, {free[k].doc_id for k in best}))
    found = quality._exchanged(rows.union(rows.limit(50)), known, weights, (3, 7), set())
    assert [(a, b, {r.doc_id for r in c}) for a, b, c in found] == [e for e in expected if e[2]] and found


def test_quality_without_evidence(spark, documents, nothing):
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality.co_train(documents, labels) is None
    rows = quality.score(documents, None).collect()
    assert len(rows) == documents.count()
    assert all(r.score == (0.0 if r.doc_id < 3 else 1.0) for r in rows)
    assert quality.co_train(nothing, labels) is None and quality.score(nothing, None).isEmpty()


def test_language_of_held_out_documents(spark):
    documents, _ = make(spark)
    rows = {r.doc_id: r for r in language_id.held_out(documents).collect()}
    assert len(rows) == 240 and 40 < sum(r.held_out for r in rows.values()) < 120
    assert all(r.lang_pred == ("aa", "bb", "cc")[k % 3] and 0 <= r.score <= 1 for k, r in rows.items())


def test_language_of_few_training_documents(spark, monkeypatch):
    documents, _ = make(spark, 900)
    last = linear.hash_order(F.col("doc_id")).desc()  # far from the first in hash order
    few = [r.doc_id for r in documents.filter("lang = 'cc'").orderBy(last).limit(6).collect()]
    monkeypatch.setattr(language_id, "SAMPLE", 60)
    model = language_id.train(documents.filter((F.col("lang") != "cc") | F.col("doc_id").isin(few)))
    assert model.languages == ["aa", "bb", "cc"]
    found = language_id.predict(documents, model).collect()
    assert all(r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3] for r in found)


def test_sample_has_every_label(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id = 77 THEN 'x' WHEN id < 1000 THEN 'y' ELSE 'z' END AS lang")
    chosen, counts = linear.sample_per_label(rows.union(rows), "doc_id", "lang", 100)
    assert counts == {"x": 1, "y": 999, "z": 4000}
    assert {x: sum(c[1] == x for c in chosen) for x in counts} == {"x": 1, "y": 20, "z": 80} and len(set(chosen)) == 101
    assert chosen == linear.sample_per_label(rows.repartition(9), "doc_id", "lang", 100)[0]


def test_language_ignores_labels_of_held_out_documents(spark):
    import zlib

    documents, _ = make(spark, 60)
    changed = spark.createDataFrame([(r.doc_id, r.text, "zz" if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.lang) for r in documents.collect()], "doc_id long, text string, lang string")
    a, b = (sorted(map(str, language_id.held_out(d).collect())) for d in (documents, changed))
    assert a == b


def test_language_without_letters_or_training(spark, documents, nothing):
    rows = {r.doc_id: r for r in language_id.held_out(documents).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (0, 1, 2)) and rows[6].lang_pred == "en"
    unknown = documents.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in language_id.held_out(unknown).collect()} == {"und"}
    assert language_id.held_out(nothing).isEmpty()


def test_training_rows_are_the_same_in_every_run(spark):
    rows = spark.range(3000).selectExpr("id % 300 AS doc_id", "concat('text ', id) AS text", "CAST(id % 2 AS int) AS good")
    chosen, _ = linear.sample_per_label(rows.select("doc_id", "good").distinct(), "doc_id", "good", 100)
    found = [linear.rows_of(rows.repartition(n), "doc_id", chosen, "good") for n in (1, 3, 11)]
    assert found[0] == found[1] == found[2]
    assert [(r.doc_id, r.good) for r in found[0]] == sorted(chosen, key=lambda c: (str(c[0]), str(c[1])))


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(1)
    x = rng.random((400, 50))
    y = (x[:, 0] > 0.5).astype(int)
    weights = linear.follow_the_leader(x, y, 2, l1=2.0)
    assert (weights == 0).mean() > 0.4 and np.abs(weights[0]).max() == np.abs(weights).max()
