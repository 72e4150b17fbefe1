"""Ranks, cumulative shares, deduplication by order, top-k with explicit ties, line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import counting, lines
from .registry import Tables, query


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def keep_first(t: Tables) -> DataFrame:
    """The first row of each key in a stated order."""
    rows = t.documents.select("source", "doc_id", "n_chars")
    return counting.top_per_group(rows, ["source"], [F.col("doc_id")], 1)


@query(
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
            s AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS place, sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM c)
       SELECT p_brand, n, place, round(100.0 * upto / total, 6) AS share FROM s WHERE 100.0 * (upto - n) < 80.0 * total"""
)
def cumulative_share(t: Tables) -> DataFrame:
    """The most frequent values that together make 80 percent of the rows."""
    return counting.covering_items(counting.value_counts(t.part, "p_brand"), "p_brand", 80.0)


@query("SELECT p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) ORDER BY n DESC, p_type LIMIT 20 OFFSET 80")
def rank_slice(t: Tables) -> DataFrame:
    return counting.value_counts(t.part, "p_type").orderBy(F.desc("n"), "p_type").offset(80).limit(20)


@query("SELECT month, n, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)")
def sequential_index(t: Tables) -> DataFrame:
    """Months numbered from 0: the window sees a row per month."""
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("idx", (F.row_number().over(Window.orderBy("month")) - 1).cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT p_brand, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_brand ORDER BY n DESC, first_seen LIMIT 10")
def most_common(t: Tables) -> DataFrame:
    """Ties go to the value that came first."""
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10)


@query("SELECT n_name, length(n_name) AS len FROM nation ORDER BY len DESC, n_name LIMIT 5")
def longest_first(t: Tables) -> DataFrame:
    return t.nation.select("n_name", F.length("n_name").cast("long").alias("len")).orderBy(F.desc("len"), "n_name").limit(5)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'click' OR regexp_matches(props, '(?i)\"k\": 1') ORDER BY ts DESC, event_id LIMIT 100")
def search_recent(t: Tables) -> DataFrame:
    hits = t.events.filter((F.col("event_type") == "click") | F.col("props").rlike('(?i)"k": 1'))
    return hits.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))[1:3], ' ') AS firsts FROM documents")
def first_alphabetical(t: Tables) -> DataFrame:
    """The first three different words in code-point order."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    return t.documents.select("doc_id", F.array_join(F.slice(words, 1, 3), " ").alias("firsts"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH l AS (SELECT doc_id, pos, contains(line, 'th') AS hit FROM {_LINES}),
             h AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM l WHERE hit),
             g AS (SELECT doc_id, min(pos) FILTER (gap > 3) AS cut FROM h GROUP BY doc_id)
        SELECT h.doc_id, count(*) AS hits, max(pos)::INTEGER AS last_line FROM h JOIN g ON h.doc_id = g.doc_id WHERE cut IS NULL OR pos < cut GROUP BY h.doc_id"""
)
def gap_cutoff(t: Tables) -> DataFrame:
    """Matching lines of a text up to the first gap of three lines without a match."""
    rows = lines.text_lines(t.documents, "doc_id", "text").withColumn("hit", F.col("line").contains("th"))
    kept = lines.until_gap(rows, "doc_id", "pos", F.col("hit"), 3)
    return kept.groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("pos").alias("last_line"))


@query(
    f"""WITH f AS (SELECT doc_id, min(pos) AS at FROM {_LINES} WHERE contains(line, 'an') GROUP BY doc_id)
        SELECT l.doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM {_LINES} l JOIN f ON l.doc_id = f.doc_id AND l.pos BETWEEN f.at - 2 AND f.at + 2 GROUP BY l.doc_id"""
)
def context_window(t: Tables) -> DataFrame:
    """The lines around the first line with a keyword, within each row: no shuffle of lines."""
    around = lines.around_first(t.documents, "text", "an", 2)
    return around.filter("lines IS NOT NULL").select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))
