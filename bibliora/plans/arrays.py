"""Operators on list and map columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists as fn
from .registry import Tables, query

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))


@query(f"SELECT doc_id, {_WORDS}[1] AS first, coalesce({_WORDS}[2], '') AS second FROM documents")
def first_element(t: Tables) -> DataFrame:
    return _words(t).select("doc_id", F.get("w", F.lit(0)).alias("first"), F.coalesce(F.get("w", F.lit(1)), F.lit("")).alias("second"))


@query(f"SELECT doc_id, array_to_string(list_transform({_WORDS}, lambda x: CASE x WHEN 'the' THEN 'THE' WHEN 'de' THEN 'DE' ELSE x END), ' ') AS mapped FROM documents")
def array_map_replace(t: Tables) -> DataFrame:
    return _words(t).select("doc_id", F.array_join(fn.mapped_items("w", {"the": "THE", "de": "DE"}), " ").alias("mapped"))


@query(f"SELECT doc_id, len(w)::INTEGER AS before, greatest(len(w), 4)::INTEGER AS after FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def pad_array(t: Tables) -> DataFrame:
    return _words(t).select("doc_id", F.size("w").alias("before"), F.size(fn.padded_to("w", 4)).alias("after"))


@query(
    f"""SELECT doc_id, array_to_string(a, '|') AS a, array_to_string(b, '|') AS b FROM (SELECT doc_id, {_WORDS} AS a, list_sort({_WORDS}) AS b FROM documents) WHERE a IS DISTINCT FROM b"""
)
def list_mismatch(t: Tables) -> DataFrame:
    """Rows whose two lists differ in order or number."""
    rows = _words(t).select("doc_id", F.col("w").alias("a"), F.array_sort("w").alias("b"))
    return rows.filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def split_clean(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(fn.split_clean(F.concat("p_name", F.lit(" , ,"), "p_brand"), ","), "|").alias("parts"))


@query(f"SELECT doc_id, array_to_string({_WORDS}[1:3], ', ') AS firsts FROM documents")
def slice_join(t: Tables) -> DataFrame:
    return _words(t).select("doc_id", F.array_join(F.slice("w", 1, 3), ", ").alias("firsts"))


@query(f"SELECT doc_id, len(CASE WHEN list_contains(w, 'the') THEN w ELSE list_append(w, 'the') END)::INTEGER AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def append_if_absent(t: Tables) -> DataFrame:
    return _words(t).select("doc_id", F.size(fn.with_item("w", "the")).alias("n"))


@query("SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey")
def alias_invert(t: Tables) -> DataFrame:
    """A map from canonical names to aliases turned into one row per alias."""
    lists = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("canonical")).agg(F.collect_list("n_name").alias("aliases"))
    return fn.inverted(lists, "canonical", "aliases", "alias")


@query(f"SELECT doc_id, len(list_distinct(list_transform({_WORDS}, lambda x: lower(x))))::INTEGER AS n FROM documents")
def array_distinct_ordered(t: Tables) -> DataFrame:
    """Items without repeats in any case; the first spelling stays."""
    return _words(t).select("doc_id", F.size(fn.distinct_ignoring_case("w")).alias("n"))


@query(f"WITH d AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents) SELECT doc_id FROM d WHERE len(list_intersect(w, ['the', 'of'])) = 2")
def subset_match(t: Tables) -> DataFrame:
    """Rows whose list has all wanted items."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return t.documents.filter(fn.has_all(words, "the", "of")).select("doc_id")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE 2 END::INTEGER AS n, 'a' || (doc_id % 3) AS first FROM documents")
def parse_list(t: Tables) -> DataFrame:
    """Stored list literals as arrays."""
    literal = F.concat(F.lit("['a"), (F.col("doc_id") % 3).cast("string"), F.lit("', None]"))
    items = fn.parsed_list(literal)
    return t.documents.select("doc_id", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first"))


@query("SELECT conv_id, string_agg(role || ': ' || text, '; ' ORDER BY turn) AS formatted FROM conversations GROUP BY conv_id")
def zip_format(t: Tables) -> DataFrame:
    """ "author: affiliation" pairs of two parallel lists as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("x"))))
    lists = t.conversations.groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.transform("o", lambda s: s["role"]).alias("a"), F.transform("o", lambda s: s["x"]).alias("b"))
    return lists.select("conv_id", fn.pairs_text("a", "b").alias("formatted"))


@query("SELECT s_suppkey // 10 AS batch, string_agg('id:' || s_suppkey, ' OR ' ORDER BY s_suppkey) AS condition FROM supplier GROUP BY 1")
def id_batches(t: Tables) -> DataFrame:
    """Ids in batches, as the disjunction that a lookup service takes."""
    ids = F.array_sort(F.collect_list("s_suppkey"))
    return t.supplier.groupBy(F.floor(F.col("s_suppkey") / 10).alias("batch")).agg(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("id:"), x.cast("string"))), " OR ").alias("condition"))
