"""Exact top-k search by inner product of integer vectors, by distributed histogram selection.

Queries come in blocks of at most about BLOCK; a block goes to every task, and rows meet it in slices of a batch.
Scores are integers. A pass scores everything and counts, for each query, scores by bucket of the score range that
still holds the k-th best; the counts of all tasks are summed, and the bucket where the k-th best lies, found in the
cluster, becomes the next range, until a range is one score wide. A task counts only from the top until it has k, for what lies lower
cannot be the k-th best. The last pass keeps the rows at or above each query's k-th score; where more than k do, the
tie at the k-th score goes to the smaller ids. No candidate list is ever sorted across the cluster.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do pairs of
different lengths; fewer than k candidates give all; rows with the query's id are not candidates, and a repeated
candidate id counts as often as it is there; of rows that repeat a query's id the one with the least vector asks; no
queries or no rows give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, queries_of, query_blocks, usable
from .workspace import Collected

BLOCK, BUCKETS, ROWS, SCALE = 2048, 4096, 2048, 1024
SCHEMA = "query_id long, rank int, vec_id long, score long"


def _scores(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of candidate rows and their integer scores, a row of scores per query. Doubles hold the sums exactly."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            same = np.asarray(part.column("v").value_lengths()) == vectors.shape[1]
            part = part.filter(pa.array(same))
            if part.num_rows:
                yield part.column("vec_id").to_numpy(), vectors @ matrix(part.column("v")).T


def _reached(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> dict[int, int]:
    """The bucket of each query's k-th best score, from counts of scores by bucket; none if there are fewer than k.

    Scores from ``low`` on count, the last bucket taking all above. One row a query comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for found, scores in _scores(batches, vectors):
            for q in range(len(ids)):
                own = scores[q][(scores[q] >= low[q]) & (found != ids[q])]
                if len(own):
                    bucket = np.minimum((own - low[q]) // width[q], BUCKETS).astype(np.int64)
                    counts[q] = counts.get(q, 0) + np.bincount(bucket, minlength=BUCKETS + 1)
        out: list[tuple[int, int, int]] = []
        for q, row in counts.items():
            many = 0
            for b in np.flatnonzero(row)[::-1].tolist():
                out.append((q, b, int(row[b])))
                many += int(row[b])
                if many >= k:
                    break
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["q", "bucket", "n"])

    counts = rows.mapInArrow(run, "q long, bucket long, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bucket")))
    return {r.q: r.bucket for r in counts.withColumn("above", above).filter(F.col("above") >= k).groupBy("q").agg(F.max("bucket").alias("bucket")).collect()}


def _kth_scores(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, bound: float) -> np.ndarray:
    """Each query's k-th best score, or its lowest possible one if there are fewer than k candidates."""
    low, high = np.full(len(ids), -bound), np.full(len(ids), bound + 1)
    while True:
        width = np.maximum(np.ceil((high - low) / BUCKETS), 1)
        bucket = _reached(rows, ids, vectors, low, width, k)
        for q in range(len(ids)):
            if q in bucket:
                low[q], high[q] = low[q] + bucket[q] * width[q], low[q] + (bucket[q] + 1) * width[q]
            else:
                high[q] = low[q] + 1
        if (width == 1).all():
            return low


def top_k(embeddings: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which the SQL condition ``is_query`` holds.

    Components become floor(SCALE * x); the score is the integer inner product; ties go to the smaller id.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = embeddings.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    values = rows.select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))
    queries = queries_of(rows.select(F.col(key), whole.alias("v")), is_query, key, "v").select(F.col(key).cast("long").alias("vec_id"), "v")
    largest = values.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    found = Collected(embeddings.sparkSession, SCHEMA, "top-k")
    for ids, vectors in query_blocks(queries, "vec_id", "v", BLOCK):
        bound = float(np.ceil(np.sqrt(largest * (vectors * vectors).sum(axis=1).max()))) + 1
        least = _kth_scores(values, ids, vectors, k, bound)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors, least: np.ndarray = least) -> Iterator[pa.RecordBatch]:
            for names, scores in _scores(batches, vectors):
                q, c = np.nonzero((scores >= least[:, None]) & (names[None, :] != ids[:, None]))
                # of a slice's ties at the k-th score only the k smallest ids can be chosen
                order = np.lexsort((names[c], -scores[q, c], q))
                q, c = q[order], c[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, c = q[place < k], c[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names[c]), pa.array(scores[q, c].astype(np.int64))], names=["query_id", "vec_id", "score"])

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kept = values.mapInArrow(run, "query_id long, vec_id long, score long")
        ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.add(ranked.select("query_id", "rank", "vec_id", "score"))
    return found.table()
