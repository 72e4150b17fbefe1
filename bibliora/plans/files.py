"""Queries through files and stores: what tables hold is written in a foreign form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import records
from ..streaming.store import KeyedStore
from .registry import Tables, query, shared_path


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
             k AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, pos) AS lines FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '----------') GROUP BY conv_id),
             f AS (SELECT conv_id, count(*) FILTER (role = 'user') AS failures FROM conversations GROUP BY conv_id)
        SELECT conv_id::VARCHAR AS title, coalesce(lines, '') AS lines, failures FROM f LEFT JOIN k USING (conv_id)"""
)
def record_files(t: Tables) -> DataFrame:
    """Conversations as section files, a record of many lines each with a notice for every turn of a user, read in byte ranges."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", records.FAILED + "\n").otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))))
    talks = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("body"))
    path = shared_path(t.spark, "records")
    talks.select(F.concat(F.lit(records.PAPER), "conv_id", F.lit("\n" + "-" * 80 + "\n" + records.SECTION + "\n"), "body").alias("value")).write.text(path)
    found = records.affiliation_lines(t.spark, path)
    return found.select("title", F.array_join("lines", "\n").alias("lines"), "failures")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, count(*) AS orders FROM orders GROUP BY o_custkey")
def upsert_store(t: Tables) -> DataFrame:
    """The latest order of each customer in a keyed store that takes the orders in three batches, the second one twice; and
    how many orders a customer has, by a store of all of them."""
    latest, every = (KeyedStore(t.spark, shared_path(t.spark, "store"), keys, buckets=16, order=["o_orderdate", "o_orderkey"]) for keys in (["o_custkey"], ["o_custkey", "o_orderkey"]))
    for number, part in enumerate((2, 0, 0, 1)):
        batch = t.orders.filter(F.col("o_orderkey") % 3 == part).select("o_custkey", "o_orderkey", "o_orderdate")
        latest.upsert(batch, min(number, 1) if part == 0 else number)
        every.upsert(batch, min(number, 1) if part == 0 else number)
    counts = every.read().groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return latest.read().select("o_custkey", F.col("o_orderkey").alias("last_order")).join(counts, "o_custkey")
