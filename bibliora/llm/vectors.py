"""What the vector searches share: usable vectors as matrices, queries in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and free of null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of vectors of one length as doubles, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def queries_of(rows: DataFrame, is_query: str, key: str, vector: str) -> DataFrame:
    """The rows for which a SQL condition holds, one for each key: of several the one with the least vector."""
    return rows.filter(is_query).groupBy(key).agg(F.min(vector).alias(vector))


def query_blocks(queries: DataFrame, key: str, vector: str, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of about ``most`` rows by hash of the key, each gathered when it is its turn."""
    blocks = -(-queries.count() // most)
    for k in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k).select(key, vector).orderBy(key).collect()
        by_size: dict[int, list] = {}
        for row in rows:
            by_size.setdefault(len(row[1]), []).append(row)
        for some in by_size.values():
            yield np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.float64)
