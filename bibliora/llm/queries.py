"""Thin queries over the operators, one per operator, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_topk, language_id, lexical_search, mixing, near_dedup, one_bit_search, quality, substring_dedup, token_counts, token_store, tokenization, warc, workspace

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.co_train(documents, _table(spark, sf_dir, "labels")))


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"), n=4, percent=80).drop("text_hash")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS m, y.n AS n, count(*) AS common FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (m + n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, o.least AS component_id, s.doc_id = o.least AS kept
FROM s JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) o ON s.doc_id = o.a
"""


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS position
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM r),
f AS (SELECT *, most / weight AS full_at FROM w),
l AS (SELECT *, (total::DOUBLE - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT source, source_size, least(most, weight * first_value(level) OVER (ORDER BY level >= full_at, full_at, rank)) AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
m AS (SELECT *, target - whole * source_size AS need FROM n),
p AS (SELECT d.*, m.source_size, m.target, m.whole, m.need,
             sum(size) OVER (PARTITION BY d.source ORDER BY position RANGE UNBOUNDED PRECEDING) AS reached,
             sum(size) OVER (PARTITION BY d.source, position) AS here
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
b AS (SELECT source, min(position) AS below FROM p WHERE need > 0 AND reached >= need GROUP BY source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN p.position < b.below OR (p.position = b.below AND 2 * (need - (reached - here)) > here) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.fresh_path(spark, "warc")
    runs = workspace.saved(warc.write_archives(_table(spark, sf_dir, "pages"), folder), "warc-runs")
    index = workspace.saved(warc.merged_index(runs, int(spark.conf.get("spark.sql.shuffle.partitions"))), "warc-index")
    workspace.remove(spark, warc.runs_folder(folder))
    workspace.discard(runs)
    return warc.read_archives(spark, folder, index)


OP4_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < winner THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d
"""


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.nearest_neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS length FROM e),
u AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * c.length) AS score
  FROM u q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode_digests(_table(spark, sf_dir, "documents"), tokenization.tokenizer_path())


def op8_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT line, doc_id, unnest(range(1, len(words) - 48)) AS place, words FROM d WHERE len(words) >= 50),
h AS (SELECT line, doc_id, place, sha256(array_to_string(words[place:place + 49], ' ')) AS content FROM w),
f AS (SELECT content, min(doc_id) AS least FROM h GROUP BY content),
g AS (SELECT line, place FROM h JOIN f USING (content) WHERE least < doc_id),
p AS (SELECT line, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM d),
c AS (SELECT line, p.place, word, max(g.place) OVER (PARTITION BY line ORDER BY p.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM p LEFT JOIN g USING (line, place)),
k AS (SELECT line, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM c GROUP BY line)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (line)
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.fresh_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), folder, tokenization.tokenizer_path(), end_id=1)
    return token_store.read_checksums(spark, folder)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenization.tokenizer_path())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
a AS (SELECT count(*)::HUGEINT AS n_all, sum(n)::HUGEINT AS l_all FROM n),
tf AS (SELECT term, doc_id, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, a GROUP BY term, n_all),
s AS (SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * a.n_all) // a.l_all)))) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM e JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 1)) // ((sum(c) OVER (PARTITION BY lang))::HUGEINT + v) AS q FROM whole JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES: dict[str, Query] = {
    "op1_co_trained_quality": op1_co_trained_quality,
    "op2_superminhash_dedup": op2_superminhash_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc_archives": op4_warc_archives,
    "op5_exact_topk": op5_exact_topk,
    "op6_one_bit_search": op6_one_bit_search,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_fm_index_dedup": op8_fm_index_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_store": op10_token_store,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_divergence": op13_source_divergence,
}
#: SQL cannot express the others; tests hold them against brute force, the tokenizers library or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_superminhash_dedup": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_warc_archives": OP4_SQL,
    "op5_exact_topk": OP5_SQL,
    "op6_one_bit_search": OP6_SQL,
    "op8_fm_index_dedup": OP8_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
