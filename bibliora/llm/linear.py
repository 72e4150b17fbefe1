"""What the text classifiers share: a bounded sample of rows, hashed character n-grams, probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Odd factors of a multiplicative hash of n-grams: one for the bucket, and one for each place.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 31, 9, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def hash_order(key: Column) -> Column:
    """A pseudo-random order of rows by an id, the same in every run."""
    return F.xxhash64(F.lit("sample"), key.cast("string"))


def sample_per_label(rows: DataFrame, key: str, label: str, most: int) -> tuple[list[tuple], dict]:
    """About ``most`` (key, label) in hash order, and how many keys each label has in all of ``rows`` (key, label).

    Each label has its share of ``most``, but a rarer one up to a tenth of ``most`` (less if there are over ten labels), or
    all that it has: so no label is missing, and with up to ``most`` labels these are at most about twice ``most``.
    Rows far above a label's cut are left out by their hash alone before the rest is ranked.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count_distinct(key)).collect()}
    if not counts:
        return [], counts
    many, least = sum(counts.values()), max(1, most // max(10, len(counts)))
    quotas = {x: max(round(most * n / many), min(n, least)) for x, n in counts.items()}
    # hashes are even over the whole range: at this share of it more than the quota is below, but for one chance in billions
    near = [(x, q, min(2**63 - 1, int((q + 7 * q**0.5 + 40) / counts[x] * 2**64) - 2**63)) for x, q in quotas.items()]
    cuts = rows.sparkSession.createDataFrame(near, f"_label {rows.schema[label].dataType.simpleString()}, _quota long, _cut long")
    below = rows.select(key, label, hash_order(F.col(key)).alias("_h")).join(F.broadcast(cuts), F.col(label) == F.col("_label")).filter("_h <= _cut").drop("_label").distinct()
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    chosen = below.withColumn("_place", place).filter("_place <= _quota").select(key, label).collect()
    return sorted((tuple(r) for r in chosen), key=lambda r: (str(r[0]), str(r[1]))), counts


def rows_of(rows: DataFrame, key: str, chosen: list[tuple], label: str) -> list:
    """A row for each chosen (key, label), in the order of the keys: these alone leave their tasks. Rows without labels get
    them by key. Of rows with one key and label the one of the smallest hash over all its columns is taken, so that reruns
    learn from the same rows however often a key is repeated."""
    if not chosen:
        return []
    kinds = dict(rows.dtypes)
    wanted = rows.sparkSession.createDataFrame(chosen, f"{key} {kinds[key]}, {label} {kinds.get(label, 'int')}")
    found = rows.join(F.broadcast(wanted), [key] + [label] * (label in kinds))
    one = F.min_by(F.struct(*found.columns), F.struct(F.xxhash64(*found.columns), F.hash(*found.columns)))
    best = found.groupBy(F.col(key).alias("_key"), F.col(label).alias("_label")).agg(one.alias("_row")).select("_row.*")
    return sorted(best.collect(), key=lambda r: (str(r[key]), str(r[label])))


def every_fifth(labels: np.ndarray) -> np.ndarray:
    """Every fifth row of each label, so that a label's first rows are always trained on."""
    aside = np.zeros(len(labels), bool)
    for label in np.unique(labels):
        aside[np.flatnonzero(labels == label)[4::5]] = True
    return aside


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as code points, each between two line ends, and where each starts (the last is the end)."""
    joined = ["\n" + t.lower() + "\n" for t in texts]
    sizes = np.array([len(t) for t in joined], np.int64)
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def count_matrix(texts: list[str], sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Counts of the hash buckets of all character n-grams, a row per text; ``buckets`` is a power of two."""
    points, first = code_points(texts)
    row = np.repeat(np.arange(len(texts)) * buckets, np.diff(first))
    counts = np.zeros(len(texts) * buckets + 1, np.float32)
    value = np.zeros(len(points), np.uint32)
    for n in range(1, max(sizes) + 1):
        many = len(points) - n + 1
        if many < 1:
            break
        value = value[:many] + points[n - 1 :] * _FACTORS[n]
        if n in sizes:
            bucket = ((value + _FACTORS[0] * np.uint32(n)) * _FACTORS[0]) >> np.uint32(33 - buckets.bit_length())
            at = row[:many] + bucket
            across = (first[1:, None] - np.arange(1, n)).ravel()  # n-grams that go on in the next text
            at[across[across < many]] = len(counts) - 1
            counts += np.bincount(at, minlength=len(counts))
    return counts[:-1].reshape(len(texts), buckets)


def by_length(batch: pa.RecordBatch, column: str, most: int = 32, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` rows and about ``size`` bytes of text."""
    from .words import slices

    for part in slices(batch, column, size):
        for at in range(0, part.num_rows, most):
            yield part.slice(at, most)


def softmax(scores: np.ndarray) -> np.ndarray:
    """Probabilities from scores, a row each."""
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, from a fixed grid, at which the scores' probabilities have the least log loss on the labels."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def follow_the_leader(rows: np.ndarray, labels: np.ndarray, classes: int, l1: float = 0.002, l2: float = 0.002, alpha: float = 0.5, beta: float = 1.0, passes: int = 4, batch: int = 16) -> np.ndarray:
    """Weights of multinomial logistic regression by FTRL-proximal with an elastic net, over small batches."""
    z, n = np.zeros((rows.shape[1], classes)), np.zeros((rows.shape[1], classes))
    truth = np.eye(classes)[labels]

    def current() -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0)

    order = np.random.default_rng(0)
    for _ in range(passes):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = shuffled[at : at + batch]
            x, weights = rows[some], current()
            gradient = x.T @ (softmax(x @ weights) - truth[some]) / len(x)
            squares = gradient * gradient
            z += gradient - (np.sqrt(n + squares) - np.sqrt(n)) / alpha * weights
            n += squares
    return current()
