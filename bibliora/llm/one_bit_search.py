"""Approximate nearest neighbours by cosine over randomly rotated one-bit codes.

Indexing rotates every unit vector by one random orthogonal matrix and keeps the signs of its coordinates, packed,
with a correction scalar f: the inner product of the vector with its code's unit vector. For a query q, <code, q> / f
estimates the cosine without bias, with an error of at most e * sqrt((1 - f^2) / (f^2 * (d - 1))) but with a small
chance that ERROR, the factor e, sets. A search first reads the codes alone, and finds each query's k-th best lower
bound among all rows. Then rows whose upper bound reaches it are reranked with their original vectors, in double
precision; of the others the vectors are not looked at.

The rotation depends on the dimension and SEED alone, so the index needs no fitting; every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do pairs
of different lengths; fewer than k candidates give all that are found; ties go to the smaller id; rows with the
query's id are not candidates; of rows that repeat a query's id the one with the least vector asks; no queries or no rows give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, queries_of, query_blocks, usable
from .workspace import Collected, discard, saved

SEED, ERROR, BLOCK, ROWS = 7, 2.5, 2048, 2048


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: cosines stay the same to the last bit, and
    lengths of very small or very large vectors neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def build_index(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, size, code, correction, v, length) of every usable row: packed signs, correction scalar, original vector, and
    the length that it has when scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes = np.asarray(part.column("v").value_lengths())
                for size in np.unique(sizes):
                    some = part.filter(pa.array(sizes == size))
                    vectors = scaled(matrix(some.column("v")))
                    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    turned = units @ rotation(int(size))
                    packed = np.packbits(turned > 0, axis=1)
                    correction = np.abs(turned).sum(axis=1) / np.sqrt(size)
                    codes = pa.array([row.tobytes() for row in packed], pa.binary())
                    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                    columns = [some.column("vec_id"), pa.array(np.full(len(codes), size, np.int32)), codes, pa.array(correction), some.column("v"), pa.array(lengths)]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "size", "code", "correction", "v", "length"])

    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    rows = embeddings.filter(usable(F.col(vector)) & nonzero & F.col(key).isNotNull())
    values = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return values.mapInArrow(run, "vec_id long, size int, code binary, correction double, v array<double>, length double")


def _estimates(part: pa.RecordBatch, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of every query with every row, from the rows' codes, and the rows' error bounds."""
    size, f = turned.shape[1], part.column("correction").to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(f), -1), axis=1, count=size)
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    return (turned @ signs.T) / f.astype(np.float32), (ERROR * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * max(size - 1, 1)))).astype(np.float32)


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            part = part.filter(pa.array(part.column("size").to_numpy() == size))
            if part.num_rows:
                yield part


def _bars(index: DataFrame, ids: np.ndarray, turned: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best lower bound among all rows, from the codes alone: one number a query is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf, np.float32)
        for part in _parts(batches, turned.shape[1]):
            estimate, error = _estimates(part, turned)
            lower = np.where(part.column("vec_id").to_numpy()[None, :] == ids[:, None], -np.inf, estimate - error)
            best = np.partition(np.hstack([best, lower]), -k, axis=1)[:, -k:]
        q, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, place].astype(np.float64))], names=["q", "lower"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))
    rows = index.select("vec_id", "size", "code", "correction").mapInArrow(run, "q long, lower double").withColumn("place", place).filter(F.col("place") == k)
    bars = np.full(len(ids), -np.inf)
    for r in rows.select("q", "lower").collect():
        bars[r.q] = r.lower
    return bars


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) the k nearest found in ``index``."""
    found = Collected(index.sparkSession, "query_id long, rank int, vec_id long, score double", "nearest")
    for ids, vectors in query_blocks(queries, "vec_id", "v", BLOCK):
        vectors = scaled(vectors)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        turned = ((vectors / norms[:, None]) @ rotation(vectors.shape[1])).astype(np.float32)
        bars = _bars(index, ids, turned, k)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors, norms: np.ndarray = norms, turned: np.ndarray = turned, bars: np.ndarray = bars) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches, turned.shape[1]):
                estimate, error = _estimates(part, turned)
                names = part.column("vec_id").to_numpy()
                # a little below the bar, for the estimates are in single precision
                q, c = np.nonzero((estimate + error >= (bars - 1e-5)[:, None]) & (names[None, :] != ids[:, None]))
                rows, place = np.unique(c, return_inverse=True)  # of these alone the original vectors are looked at
                originals, lengths = scaled(matrix(part.column("v").take(pa.array(rows)))) if len(rows) else vectors[:0], part.column("length").to_numpy()
                exact = np.concatenate([np.einsum("ij,ij->i", vectors[q[s : s + 65536]], originals[place[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.empty(0)]) / (norms[q] * lengths[c])
                order = np.lexsort((names[c], -exact, q))
                q, c, exact = q[order], c[order], exact[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[kept]]), pa.array(names[c[kept]]), pa.array(exact[kept])], names=["query_id", "vec_id", "score"])

        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = index.mapInArrow(run, "query_id long, vec_id long, score double")
        ranked = near.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        found.add(ranked.select("query_id", "rank", "vec_id", "score"))
    return found.table()


def nearest_neighbours(embeddings: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """The k nearest of every row of ``embeddings`` (vec_id, embedding) for which the SQL condition holds."""
    index = saved(build_index(embeddings), "one-bit-index")
    found = search(index, queries_of(index.select("vec_id", "v"), is_query, "vec_id", "v"), k)
    discard(index)
    return found
