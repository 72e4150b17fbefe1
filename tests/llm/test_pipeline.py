import hashlib
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bibliora.llm import quality, tokenization

from .conftest import words
from .test_mixing import targets
from .test_near_dedup import brute_force as groups_of
from .test_substring_dedup import brute_force as removals_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "intervals string, whole int, below int, more boolean, target double, score double, keep boolean, component_id long, kept boolean, bucket int, anchor int, head int, size int, _copies int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [None, "", base, base, base + " and more", "tiny"]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(8)] + [words(rng, rng.randrange(20, 80)) for _ in range(60)]
    texts += [" ".join(w.upper() + "!!" for w in words(rng, 50).split()) for _ in range(25)]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[20])
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(k, 0 if t.endswith("!!") else 1, 0) for k, t in enumerate(texts) if t and k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.co_train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = {r.doc_id for r in quality.score(docs, model).collect() if r.keep}
    rows = {r.doc_id: tuple(r) for r in docs.collect() if r.doc_id in keep}
    groups = groups_of(list(rows.values()), 5)
    rows = {d: r for d, r in rows.items() if groups[d][1] == d}
    texts = {}
    for d, _, gone, _ in removals_of(list(rows.values())):
        text = rows[d][1]
        if gone:
            split, cut = text.split(), removed_places(rows, d)
            text = " ".join(w for k, w in enumerate(split) if k not in cut)
        if text:
            texts[d] = text
    size, by_source = {d: len(t.split()) for d, t in texts.items()}, defaultdict(int)
    for d, n in size.items():
        by_source[rows[d][3]] += n
    goal, copies = targets(dict(by_source)), {}
    for source, total in by_source.items():
        whole = int(goal[source] // total)
        need, upto = goal[source] - whole * total, 0
        own = sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d) for d in texts if rows[d][3] == source)
        for _, d in own:
            more = need - upto > size[d] / 2 if upto + size[d] >= need else True
            copies[d] = whole + int(upto < need and more)
            upto += size[d]
    library = Tokenizer.from_file(tokenization.tokenizer_path())
    out = Counter()
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        out[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += copies[d]
    return +out


def removed_places(rows, doc):
    earlier = {tuple(w[k : k + 50]) for d, r in rows.items() if d < doc for w in [r[1].split()] for k in range(len(w) - 49)}
    own = rows[doc][1].split()
    return {j for k in range(len(own) - 49) if tuple(own[k : k + 50]) in earlier for j in range(k, k + 50)}


def test_pipeline_equals_plain_python(spark, folder):
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == before
    assert found == by_hand(spark, folder)
    assert len(found) > 40


def test_stages_keep_all_columns_whatever_their_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS `{c.split()[0]}`" for c in CLASHING.split(", ")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, wide, folder)
        assert after.columns == wide.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == wide.count()


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).isEmpty()


def test_near_dedup_stage_keeps_different_texts_of_one_id(spark):
    text, other = " ".join(map(str, range(40))), " ".join(f"o{k}" for k in range(40))
    rows = [(3, text, "en", "s", 1), (5, text, "en", "s", 1), (5, other, "en", "s", 2), (5, other, "de", "s", 2), (None, text, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = [[tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(k), "").collect()] for k in (1, 3)]
    assert sorted((r[0] or 0, r[1]) for r in found[0]) == [(0, text), (3, text), (5, other)]
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
