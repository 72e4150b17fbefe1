"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_aggregate(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, an aggregate of one row per ``key``.

    An aggregate is already dealt by its key, and then Spark would bring all rows of a key to its task: it splits a hot
    key only between two plain exchanges. So both sides are dealt by a hash of the key, which costs an exchange of the
    aggregate and none more of the rows. A null key matches nothing.
    """
    name = f"__{key}"
    found = found.withColumnRenamed(key, name)
    same = (F.xxhash64(F.col(key)) == F.xxhash64(F.col(name))) & (F.col(key) == F.col(name))
    return rows.join(found, same, how).drop(name)
