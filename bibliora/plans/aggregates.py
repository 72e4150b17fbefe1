"""Counts, means, conditional means, credit, contingency and calendar rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counting, inference, metrics
from .registry import Tables, query

_TOKENS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _papers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")


_PAPERS = "(SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"




@query(
    """SELECT d.source, count(*) AS n_papers, avg(d.n_chars) AS aac,
              sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS n_journal,
              avg(CASE WHEN l.quality = 1 THEN d.n_chars END) AS jac
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"""
)
def citation_metrics(t: Tables) -> DataFrame:
    papers = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return metrics.citation_means(papers, "source", "n_chars", None, F.col("quality") == 1)


@query(
    f"""SELECT lang, count(*) AS n_papers, avg(n_chars) AS aac, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS n_journal, avg(CASE WHEN quality = 1 THEN n_chars END) AS jac,
               avg(toxic) AS eaac, avg(CASE WHEN quality = 1 THEN toxic END) AS ejac FROM {_PAPERS} GROUP BY lang"""
)
def metric_matrix(t: Tables) -> DataFrame:
    """Four means by key in one aggregation instead of four aggregations joined."""
    return metrics.citation_means(_papers(t), "lang", "n_chars", "toxic", F.col("quality") == 1)


@query(f"SELECT source, coalesce(sum(quality), 0) / count(*) AS over_all, avg(quality) AS over_known FROM {_PAPERS} GROUP BY source")
def aac_variants(t: Tables) -> DataFrame:
    """Ratio of sums (null counts as 0 in the denominator) beside the mean of known values."""
    return _papers(t).groupBy("source").agg((F.coalesce(F.sum("quality"), F.lit(0)) / F.count("*")).alias("over_all"), F.avg("quality").alias("over_known"))


@query(f"SELECT count(*) AS n_rows, count(quality) AS known, round(100.0 * count(quality) / count(*), 6) AS percent_known FROM {_PAPERS}")
def null_profile(t: Tables) -> DataFrame:
    return _papers(t).agg(F.count("*").alias("n_rows"), F.count("quality").alias("known"), F.round(100.0 * F.count("quality") / F.count("*"), 6).alias("percent_known"))


@query(f"SELECT quality, count(*) AS n FROM {_PAPERS} WHERE quality IS NOT NULL GROUP BY quality")
def value_counts(t: Tables) -> DataFrame:
    return counting.value_counts(_papers(t), "quality")


@query(f"SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM {_PAPERS} WHERE lang IS NOT NULL GROUP BY lang")
def value_share(t: Tables) -> DataFrame:
    return counting.value_shares(_papers(t), "lang")


@query("SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang")
def group_count(t: Tables) -> DataFrame:
    return t.documents.dropna(subset=["source", "lang"]).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT round(avg(n), 6) AS mean_size FROM (SELECT count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate))")
def mean_group_size(t: Tables) -> DataFrame:
    """Mean number of rows by month, of the months that have rows."""
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate")).agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_size"))


@query("SELECT lang, avg(n_chars) AS mean_chars, sum(n_chars)::BIGINT AS sum_chars, count(n_chars) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def group_mean(t: Tables) -> DataFrame:
    return t.documents.filter("lang IS NOT NULL").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.sum("n_chars").alias("sum_chars"), F.count("n_chars").alias("n"))


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, round(max(o_totalprice), 4) AS max_price, count(DISTINCT o_custkey) AS customers
       FROM orders GROUP BY 1"""
)
def multi_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.round(F.max("o_totalprice"), 4).alias("max_price"), F.countDistinct("o_custkey").alias("customers")
    )


@query("SELECT round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_samp(n_chars), 6) AS std, max(n_chars) AS max FROM documents")
def summary_stats(t: Tables) -> DataFrame:
    stats = t.documents.agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("std"), F.max("n_chars").alias("max"))
    middle = inference.quantiles(t.documents, "n_chars", [0.5], "p").select(F.col("p")[0])
    return stats.select("mean", F.round(middle.scalar(), 6).alias("median"), "std", "max")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def arg_max_row(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(1)


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def argmax_per_group(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counting.top_per_group(counts, ["source"], [F.desc("n"), F.col("lang")], 1)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1 OFFSET 1")
def nth_largest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(1).limit(1)


@query("SELECT lower(trim(w)) AS token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def token_counts(t: Tables) -> DataFrame:
    """Lower-cased, trimmed list items; empty ones count."""
    return counting.item_counts(t.part, F.split("p_name", " "), "token")


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS w FROM documents) GROUP BY w HAVING count(*) > 1")
def word_freq(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT role, count(*) AS n FROM (SELECT unnest(list(role ORDER BY turn)) AS role FROM conversations GROUP BY conv_id) GROUP BY role")
def explode_count(t: Tables) -> DataFrame:
    lists = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return lists.select(F.explode("roles").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


_ORDER_AUTHORS = "(SELECT l_orderkey, list(DISTINCT l_suppkey) AS authors, sum(l_quantity) AS credit FROM lineitem GROUP BY l_orderkey)"


def _order_authors(t: Tables) -> DataFrame:
    """Orders in the part of papers: their suppliers are the authors, their quantity the citations."""
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("authors"), F.sum("l_quantity").alias("credit"))


@query(f"SELECT a AS author, count(*) AS papers, round(sum(credit), 4) AS total, round(sum(credit) / count(*), 6) AS per_paper FROM (SELECT unnest(authors) AS a, credit FROM {_ORDER_AUTHORS}) GROUP BY a")
def author_avg(t: Tables) -> DataFrame:
    return metrics.credit_by_item(_order_authors(t), "authors", "credit", "author")


@query(f"SELECT a AS author, round(sum(credit / n), 6) AS credit FROM (SELECT unnest(authors) AS a, len(authors) AS n, credit FROM {_ORDER_AUTHORS}) GROUP BY a")
def fractional_credit(t: Tables) -> DataFrame:
    return metrics.fractional_credit(_order_authors(t), "authors", "credit", "author")


@query(
    """WITH a AS (SELECT doc_id, n_chars, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, '.'))), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
       SELECT part, round(sum(n_chars / n), 6) AS credit FROM (SELECT unnest(parts) AS part, len(parts) AS n, n_chars FROM a) GROUP BY part"""
)
def fractional_credit_nested(t: Tables) -> DataFrame:
    """Shares of a value among the parts of a list's items, after each item is split again."""
    items = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, r"\.")))
    parts = F.filter(F.transform(items, lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return metrics.fractional_credit(t.documents.select("n_chars", parts.alias("parts")), "parts", "n_chars", "part")


@query(f"SELECT author, per_paper FROM (SELECT a AS author, round(sum(credit) / count(*), 6) AS per_paper FROM (SELECT unnest(authors) AS a, credit FROM {_ORDER_AUTHORS}) GROUP BY a) ORDER BY per_paper DESC, author LIMIT 10")
def credit_per_item(t: Tables) -> DataFrame:
    return metrics.credit_by_item(_order_authors(t), "authors", "credit", "author").select("author", "per_paper").orderBy(F.desc("per_paper"), "author").limit(10)


_GROUP_WORDS = r"(SELECT source, lower(w) AS word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY 1, 2)"


def _group_words(t: Tables) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return t.documents.select("source", words.alias("w")).groupBy("source", F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query(f"SELECT source, word, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM {_GROUP_WORDS}) WHERE r <= 5")
def topk_per_group(t: Tables) -> DataFrame:
    return counting.top_per_group(_group_words(t), ["source"], [F.desc("n"), F.col("word")], 5)


@query(f"SELECT DISTINCT word FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM {_GROUP_WORDS}) WHERE r = 1")
def winner_set(t: Tables) -> DataFrame:
    return counting.top_per_group(_group_words(t), ["source"], [F.desc("n"), F.col("word")], 1).select("word").distinct()


@query(r"SELECT lang, round(avg(length(w)), 6) AS mean_len, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) WHERE lower(w) <> 'none' GROUP BY lang")
def explode_avg_len(t: Tables) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = t.documents.select("lang", words.alias("w")).filter(F.lower("w") != "none")
    return rows.groupBy("lang").agg(F.round(F.avg(F.length("w")), 6).alias("mean_len"), F.count("*").alias("n"))


@query(f"SELECT a AS author, sum(quality)::BIGINT AS total, avg(quality) AS mean, count(*) AS n FROM (SELECT unnest([source, lang]) AS a, quality FROM {_PAPERS} WHERE quality IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL) GROUP BY a")
def explode_multi_agg(t: Tables) -> DataFrame:
    rows = _papers(t).dropna(subset=["quality", "source", "lang"]).select(F.explode(F.array("source", "lang")).alias("author"), "quality")
    return rows.groupBy("author").agg(F.sum("quality").alias("total"), F.avg("quality").alias("mean"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def crosstab(t: Tables) -> DataFrame:
    """A contingency table; the pivot's values are given, so no job looks for them."""
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return wide.toDF("o_orderpriority", "f", "o", "p")


@query(
    """WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source)
       SELECT CASE WHEN r <= 5 THEN source ELSE 'Others' END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1"""
)
def topn_others(t: Tables) -> DataFrame:
    return counting.top_and_others(t.documents, "source", 5)


@query("SELECT conv_id, string_agg(role || ': ' || text, '; ' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def grouped_concat(t: Tables) -> DataFrame:
    """Texts of a group joined in the order of their positions."""
    item = F.concat("role", F.lit(": "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", item.alias("item"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["item"]), "; ").alias("summary"))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def distinct_count(t: Tables) -> DataFrame:
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query(
    """WITH s AS (SELECT conv_id, list(CASE WHEN length(text) < 60 THEN NULL ELSE text END ORDER BY turn) AS slots FROM conversations GROUP BY conv_id),
            n AS (SELECT len(slots) AS size, len(list_filter(slots, lambda x: x IS NULL)) AS holes FROM s)
       SELECT count(*) AS papers, count(*) FILTER (holes = 0) AS full_papers, count(*) FILTER (holes > 0 AND holes < size) AS partial_papers, coalesce(sum(holes), 0)::BIGINT AS null_slots FROM n"""
)
def coverage_report(t: Tables) -> DataFrame:
    slots = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.length("text") >= 60, F.col("text")).alias("x")))), lambda x: x["x"])
    return metrics.slot_coverage(t.conversations.groupBy("conv_id").agg(slots.alias("slots")), "slots")


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING bool_and(length(text) >= 20)")
def all_members_valid(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_and(F.length("text") >= 20).alias("ok")).filter("ok").drop("ok")


@query("SELECT count(*) FILTER (n_chars > 1000) AS long_texts, count(*) FILTER (lang = 'en') AS english FROM documents")
def bool_sum(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_if(F.col("n_chars") > 1000).alias("long_texts"), F.count_if(F.col("lang") == "en").alias("english"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)
       SELECT month::VARCHAR AS month, n, day(last_day(month))::INTEGER AS days,
              (SELECT count(*) FROM generate_series(month::TIMESTAMP, last_day(month)::TIMESTAMP, INTERVAL 1 DAY) g(d) WHERE isodow(d) <= 5)::INTEGER AS business_days,
              round(n / day(last_day(month)), 6) AS per_day FROM m"""
)
def per_day_rate(t: Tables) -> DataFrame:
    months = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return metrics.with_calendar(months, "month").withColumns({"per_day": F.round(F.col("n") / F.col("days"), 6), "month": F.col("month").cast("string")})


@query(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS j FROM orders GROUP BY 1)
       SELECT month, j, round(j / n, 6) AS of_all FROM m WHERE j > 0"""
)
def monthly_ratio(t: Tables) -> DataFrame:
    """Share of flagged rows in all rows by month; months without flagged rows are absent."""
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("j"))
    return months.filter("j > 0").select("month", "j", F.round(F.col("j") / F.col("n"), 6).alias("of_all"))


@query(
    """WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT y::INTEGER AS year, m <= 6 AS first_half, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM m GROUP BY 1, 2"""
)
def half_year_stats(t: Tables) -> DataFrame:
    months = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return months.groupBy("year", (F.col("m") <= 6).alias("first_half")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"))


@query("SELECT dayname(o_orderdate) AS day, count(*) AS n FROM orders GROUP BY 1")
def day_name_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "EEEE").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1),
            c AS (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
       SELECT c.day::VARCHAR AS day, coalesce(n, 0) AS n FROM c LEFT JOIN d ON c.day = d.day"""
)
def resample_days(t: Tables) -> DataFrame:
    """Events by day, with the days that have none."""
    return metrics.resampled_days(t.events, "ts").select(F.col("day").cast("string").alias("day"), "n")


@query("SELECT (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE::VARCHAR AS week_end, count(*) AS n FROM events GROUP BY 1")
def resample_weeks(t: Tables) -> DataFrame:
    """Weeks that end on Sunday, named by that day."""
    return t.events.groupBy(F.date_add(F.to_date(F.date_trunc("week", "ts")), 6).cast("string").alias("week_end")).agg(F.count("*").alias("n"))


@query("SELECT date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INTEGER + 1 AS days FROM orders")
def date_span(t: Tables) -> DataFrame:
    return t.orders.agg((F.datediff(F.max(F.to_date("o_orderdate")), F.min(F.to_date("o_orderdate"))) + 1).alias("days"))


@query(
    """WITH d AS (SELECT date_trunc('week', ts)::DATE AS start, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type = 'error' GROUP BY 1),
            c AS (SELECT unnest(generate_series((SELECT min(start) FROM d)::TIMESTAMP, (SELECT max(start) FROM d)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS start)
       SELECT c.start::VARCHAR AS week, coalesce(n, 0) AS n FROM c LEFT JOIN d ON c.start = d.start"""
)
def resample_weeks_filled(t: Tables) -> DataFrame:
    """Errors by week from Monday, with the weeks that have none."""
    return metrics.resampled(t.events.filter("event_type = 'error'"), "ts", "week").select(F.col("start").cast("string").alias("week"), "n")


@query(
    """WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS start, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
            c AS (SELECT unnest(generate_series((SELECT min(start) FROM d)::TIMESTAMP, (SELECT max(start) FROM d)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS start)
       SELECT c.start::VARCHAR AS month, coalesce(n, 0) AS n FROM c LEFT JOIN d ON c.start = d.start"""
)
def resample_months_filled(t: Tables) -> DataFrame:
    """Large orders by month, with the months that have none."""
    return metrics.resampled(t.orders.filter("o_totalprice > 400000"), "o_orderdate", "month").select(F.col("start").cast("string").alias("month"), "n")


@query(
    """WITH l AS (SELECT max(ts)::DATE AS today FROM events)
       SELECT event_type, count(*) FILTER (ts::DATE = today) AS today, count(*) FILTER (ts::DATE = today - 1) AS yesterday FROM events, l WHERE ts::DATE >= today - 1 GROUP BY event_type"""
)
def day_windows(t: Tables) -> DataFrame:
    """Events of the table's last day and of the day before it."""
    day, today = F.to_date("ts"), t.events.agg(F.to_date(F.max("ts"))).scalar()
    rows = t.events.select("event_type", day.alias("day"), today.alias("last")).filter(F.col("day") >= F.date_sub("last", 1))
    return rows.groupBy("event_type").agg(F.count_if(F.col("day") == F.col("last")).alias("today"), F.count_if(F.col("day") == F.date_sub("last", 1)).alias("yesterday"))
