"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import increments
from .registry import Tables, query, shared_path


def _drained(t: Tables, table: str, transform, mode: str) -> DataFrame:
    """A stream over a table, one file or a folder of parts, transformed and read until nothing is left, as a table.

    The result is written by the tasks; a batch that is tried again replaces its own rows, and in complete mode each
    batch replaces all rows.
    """
    schema = t.__getattr__(table).schema
    # a pattern, as the source takes a path without one for a folder
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")
    # watermarks need instants; stored times without zone are in the session's
    stream = stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})
    found, path = transform(stream), shared_path(t.spark, "stream")
    t.spark.createDataFrame([], found.schema).write.parquet(f"{path}/rows/none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else number}")

    run = found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t: Tables) -> DataFrame:
    """Tumbling daily counts with a watermark."""
    return _drained(t, "events", lambda s: increments.daily_counts(s, "ts", "event_type"), "complete").selectExpr("CAST(day AS string) AS day", "event_type", "n")


@query("SELECT event_id, user_id FROM events")
def stream_first_of_each(t: Tables) -> DataFrame:
    """Events without repeated ids, in append mode."""
    return _drained(t, "events", lambda s: increments.first_of_each(s, "event_id", "ts").select("event_id", "user_id"), "append")
