"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed character n-grams are counted over all training documents. The weights are trained by
follow-the-regularised-leader with an elastic net (L1 keeps them sparse) on a sample of about SAMPLE training
documents, whole texts, in the hash order of their ids. The sample is drawn for each language of all training
documents, and rare languages have more than their share of it, so that none is missing at any size. A temperature,
fitted on every fifth of each language's sample, which training does not see, makes the scores probabilities. Then
every document is scored, whole text.

Defined results: a null text or one without letters is ``und`` with score 0; without training documents everything
is ``und``; a single known language is the answer for all others, with score 1; rows with a null doc_id train
nothing; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import by_length, count_matrix, every_fifth, follow_the_leader, rows_of, sample_per_label, softmax, temperature

SIZES, BUCKETS, SAMPLE = (1, 2, 3), 4096, 3000


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per bucket, and one for the constant
    temperature: float


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and how many texts there are: a row of partial counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in by_length(batch, "text"):
                found += (count_matrix([t or "" for t in part.column("text").to_pylist()], SIZES, BUCKETS) > 0).sum(axis=0)
                many += part.num_rows
        lists = pa.ListArray.from_arrays(pa.array([0, BUCKETS + 1], pa.int32()), pa.array(np.append(found, many)))
        yield pa.RecordBatch.from_arrays([lists], names=["counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            found += batch.column("counts").flatten().to_numpy().reshape(-1, BUCKETS + 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, BUCKETS + 1], pa.int32()), pa.array(found))], names=["counts"])

    partial = texts.select("text").mapInArrow(run, "counts array<long>")
    # a second level of sums keeps what reaches the driver to 64 rows however many tasks there are
    rows = partial.repartition(64).mapInArrow(total, "counts array<long>").collect()
    counts = np.sum([r.counts for r in rows] or [np.zeros(BUCKETS + 1, np.int64)], axis=0)
    return counts[:-1], int(counts[-1])


def features(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log count) * idf; and a constant column."""
    counts = count_matrix(texts, SIZES, BUCKETS)
    rows = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return np.hstack([rows, np.ones((len(texts), 1))])


def train(documents: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang) with languages; rows without text, language or id do not count."""
    known = documents.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    chosen, counts = sample_per_label(known.select("doc_id", "lang"), "doc_id", "lang", SAMPLE)
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    sample = rows_of(known, "doc_id", chosen, "lang")
    seen, many = document_frequencies(known)
    idf = np.log((1 + many) / (1 + seen)) + 1
    labels = np.array([languages.index(r.lang) for r in sample])
    rows = np.vstack([features([r.text], idf).astype(np.float32) for r in sample])
    aside = every_fifth(labels)
    weights = follow_the_leader(rows[~aside], labels[~aside], len(languages))
    fitted = temperature(rows[aside] @ weights, labels[aside]) if aside.any() else 1.0
    return Model(languages, idf, weights, fitted)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                if model.languages:
                    chances = softmax(features(texts, model.idf) @ model.weights / model.temperature)
                    best = chances.argmax(axis=1)
                    found = [(model.languages[b], float(c)) for b, c in zip(best, chances.max(axis=1), strict=True)]
                else:
                    found = [("und", 0.0)] * len(texts)
                found = [f if any(map(str.isalpha, t)) else ("und", 0.0) for t, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on documents whose crc32(doc_id as text) mod 3 is not 1."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(documents.filter(~fold))
    return predict(documents, model).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
