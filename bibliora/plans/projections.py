"""Scans, projections, predicates, conditional columns and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning
from .registry import Tables, query

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_table(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 100")
def slice_range(t: Tables) -> DataFrame:
    """Rows 101 to 200 in the order of a stable key: a bounded top-k, not a global row number."""
    return t.orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(100).limit(100)


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders")
def try_numeric(t: Tables) -> DataFrame:
    priority = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", cleaning.number_or_null(F.substring(priority, 1, 1)).alias("level"), cleaning.number_or_null(priority).alias("bad"))


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_cols(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("flag"))


@query("SELECT doc_id, CASE WHEN trim(source) IN ('', 'src0', 'src1') THEN NULL ELSE source END AS venue FROM documents")
def sentinel_to_null(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cleaning.sentinels_to_null(F.col("source"), "src0", "src1").alias("venue"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def drop_missing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").dropna(subset=["quality", "toxic"])


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
def mask_filter(t: Tables) -> DataFrame:
    return t.orders.filter(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def date_range(t: Tables) -> DataFrame:
    """Bounds on the timestamp column itself, so that they reach the scan."""
    inside = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-04-01").cast("timestamp_ntz"))
    return t.orders.filter(inside).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def membership_filter(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("source").isin("src1", "src3", "src5")).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE coalesce(regexp_matches(text, '(?i)\\bthe\\s+an'), false)")
def text_search(t: Tables) -> DataFrame:
    """Case-insensitive regex search; null text does not match."""
    return t.documents.filter(F.coalesce(F.col("text").rlike(r"(?i)\bthe\s+an"), F.lit(False))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ation')")
def substring_search(t: Tables) -> DataFrame:
    return t.documents.filter(F.lower("text").contains("ation")).select("doc_id")


@query(
    f"""WITH a AS (SELECT doc_id, list_transform({_WORDS}, lambda x: CASE WHEN length(x) < 3 THEN NULL ELSE x END) AS slots FROM documents)
        SELECT doc_id, slots IS NULL OR len(list_filter(slots, lambda x: x IS NULL)) > 0 AS has_hole,
               slots IS NOT NULL AND len(list_filter(slots, lambda x: x IS NULL)) = 0 AS is_full,
               len(list_filter(slots, lambda x: x IS NULL))::INTEGER AS n_holes FROM a"""
)
def null_slots(t: Tables) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    slots = F.transform(words, lambda x: F.when(F.length(x) >= 3, x))
    rows = t.documents.select("doc_id", slots.alias("slots"))
    return rows.select("doc_id", cleaning.has_hole(F.col("slots")).alias("has_hole"), cleaning.is_full(F.col("slots")).alias("is_full"), cleaning.holes(F.col("slots")).alias("n_holes"))


@query(
    """WITH k AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[]' WHEN 3 THEN '['''']' WHEN 4 THEN 'nan' WHEN 5 THEN 'None' ELSE source END AS kw FROM documents)
       SELECT doc_id, kw IS NULL OR lower(trim(kw)) IN ('', '[]', '['''']', '[""]', 'nan', 'none') AS missing FROM k"""
)
def missing_predicate(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    keyword = F.when(k == 1, "").when(k == 2, "[]").when(k == 3, "['']").when(k == 4, "nan").when(k == 5, "None").when(k == 6, F.col("source"))
    return t.documents.select("doc_id", cleaning.is_missing(keyword).alias("missing"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 10000 OR n_chars < 20")
def outlier_queue(t: Tables) -> DataFrame:
    return t.documents.filter((F.col("n_chars") > 10000) | (F.col("n_chars") < 20)).select("doc_id", "n_chars")


@query("SELECT o_orderkey FROM orders WHERE month(o_orderdate) NOT IN (11, 12)")
def exclude_months(t: Tables) -> DataFrame:
    return t.orders.filter(~F.month("o_orderdate").isin(11, 12)).select("o_orderkey")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 1 WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS flag,
              CASE WHEN o_orderstatus = 'F' THEN 1 WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 1 WHEN o_totalprice > 300000 THEN 1 WHEN contains(lower(o_orderpriority), 'medium') THEN 1 ELSE 0 END AS flag_wide
       FROM orders"""
)
def flag_cascade(t: Tables) -> DataFrame:
    """One CASE instead of successive updates; the wider flag admits one more keyword."""
    priority = F.lower("o_orderpriority")
    base = lambda: F.when(F.col("o_orderstatus") == "F", 1).when(cleaning.contains_any(priority, "urgent", "high"), 1).when(F.col("o_totalprice") > 300000, 1)
    return t.orders.select("o_orderkey", base().otherwise(0).alias("flag"), base().when(priority.contains("medium"), 1).otherwise(0).alias("flag_wide"))


@query(
    """SELECT sum(CASE WHEN quality = 0 AND n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS unflagged_large, sum(CASE WHEN quality = 1 AND n_chars < 100 THEN 1 ELSE 0 END)::BIGINT AS flagged_small,
              sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def consistency_checks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.agg(
        F.count_if((F.col("quality") == 0) & (F.col("n_chars") > 2000)).alias("unflagged_large"),
        F.count_if((F.col("quality") == 1) & (F.col("n_chars") < 100)).alias("flagged_small"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
    )


@query(
    """SELECT round(100.0 * avg(CASE WHEN lang = 'en' THEN toxic::DOUBLE END), 6) AS share_en, round(100.0 * avg(toxic::DOUBLE), 6) AS share_all
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def flag_share(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "toxic"), "doc_id")
    share = lambda c: F.round(100.0 * F.avg(c.cast("double")), 6)
    return rows.agg(share(F.when(F.col("lang") == "en", F.col("toxic"))).alias("share_en"), share(F.col("toxic")).alias("share_all"))


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 0 THEN 'reviewed' ELSE d.source END ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def apply_corrections(t: Tables) -> DataFrame:
    """A table of corrections wins over stored values."""
    fixes = t.labels.filter("quality = 0").select("doc_id", F.lit("reviewed").alias("fixed"))
    return t.documents.select("doc_id", "source").join(fixes, "doc_id", "left").select("doc_id", F.coalesce("fixed", "source").alias("source"))


@query("SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name, 'region', NULL FROM region")
def union_all(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("region"))
    return nations.unionByName(t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")), allowMissingColumns=True)


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("custkey")).subtract(t.orders.select("o_custkey"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))
