"""Quality classification by co-training of two views of a document.

The text view sees what is written: hashed character n-grams, and how often words repeat, shout or end in symbols.
The metadata view sees the page: source, language, length, and its layout in lines. Each view is a logistic
regression (FTRL). Both start from a sample of about SAMPLE labelled documents, drawn for each kind by itself, so that
a rare kind is not missing. In each round every view labels all unlabelled documents, whole texts, and those of all
of which it is most confident, about EXCHANGED of both kinds, become training rows of the other view. A fold of the
labelled sample that no view trains on calibrates each view's log-odds (Platt) and then weighs the two against each
other, at the kinds' shares among all labels; every document is scored with the combination, whole text.

Defined results: texts without words (null, empty, white space) score 0; without labels of both kinds nothing can be
told apart and every other document scores 1; null metadata is a value of its own; labels with a null doc_id or
quality do not count, and of repeated labels of a document the lowest does; repeated rows get equal results; extra
columns are ignored by ``score`` and kept by ``without_low_quality``.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import by_length, count_matrix, every_fifth, follow_the_leader, hash_order, rows_of, sample_per_label
from .words import text_bytes, word_hashes, word_spans
from .workspace import discard, saved

SIZES, BUCKETS, SAMPLE = (2, 3), 2048, 3000
ROUNDS, EXCHANGED, CONFIDENT, KEEP_FROM = 4, 100, 0.95, 0.5
SOURCES, LANGUAGES = 64, 16
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kinds_of_bytes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for bit, letters in ((UPPER, string.ascii_uppercase), (LOWER, string.ascii_lowercase), (DIGIT, string.digits), (PLAIN_END, string.ascii_letters + string.digits + ".,;:")):
        kinds[np.frombuffer(letters.encode(), np.uint8)] |= bit
    kinds[0xC0:] |= BEYOND  # the first byte of a character beyond ASCII, which counts as a letter
    kinds[0x80:] |= PLAIN_END
    kinds[:0x80] |= START
    kinds[0xC0:] |= START
    return kinds


UPPER, LOWER, DIGIT, PLAIN_END, BEYOND, START = (1 << k for k in range(6))
_KINDS = _kinds_of_bytes()


def _of_each(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a row of values over the parts that start at ``first`` (with the end of the last)."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first])


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different values each part has: values and parts are sorted as one number, a few bits of the hash less."""
    bits = np.uint64((len(first) - 1).bit_length())
    part = np.repeat(np.arange(len(first) - 1).astype(np.uint64), np.diff(first))
    ordered = np.sort(hashes >> bits | part << (np.uint64(64) - bits))
    new = np.ones(len(hashes), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    return _of_each(new, first)


def word_shapes(texts: list[str]) -> np.ndarray:
    """How words look, a row per text: a constant, shares of shouted words, of words that end in symbols, of different
    words and of different word pairs, shares of letters and digits, and the length of words."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(data, offsets)
    hashes, kinds = word_hashes(data, starts, ends), _KINDS[data]
    words, many = np.diff(first), np.maximum(np.diff(first), 1)
    chars = np.maximum(_of_each(kinds & START > 0, offsets), 1)
    seen = lambda bit: np.concatenate([[0], np.cumsum(kinds & bit > 0)])
    upper, lower = seen(UPPER), seen(LOWER | BEYOND)
    shouted = (upper[ends] > upper[starts]) & (lower[ends] == lower[starts])
    odd = kinds[ends - 1] & PLAIN_END == 0
    pairs = np.maximum(words - 1, 0)
    inside = np.ones(max(len(hashes) - 1, 0), bool)  # pairs that don't reach into the next text
    last = first[1:] - 1
    inside[last[(last >= 0) & (last < len(inside)) & (words > 0)]] = False
    two = (hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])[inside]
    pair_first = np.concatenate([[0], np.cumsum(pairs)])
    columns = [
        np.ones(len(texts)),
        _of_each(shouted, first) / many,
        _of_each(odd, first) / many,
        _distinct(hashes, first) / many,
        _distinct(two, pair_first) / np.maximum(pairs, 1),
        _of_each(kinds & (UPPER | LOWER | BEYOND) > 0, offsets) / chars,
        _of_each(kinds & DIGIT > 0, offsets) / chars,
        np.minimum(chars / many / 10, 3.0),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def text_view(texts: list[str]) -> np.ndarray:
    """Features of what is written, a row per text."""
    counts = np.log1p(count_matrix(texts, SIZES, BUCKETS))
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return np.hstack([counts, word_shapes(texts)])


def metadata_view(texts: list[str], languages: list, sources: list, sizes: list) -> np.ndarray:
    """Features of the page, a row per document."""
    rows = np.zeros((len(texts), SOURCES + LANGUAGES + 8), np.float32)
    for k, (text, language, source, size) in enumerate(zip(texts, languages, sources, sizes, strict=True)):
        lines = text.split("\n")
        long = max(map(len, lines))
        rows[k, zlib.crc32(repr(source).encode()) % SOURCES] = 1
        rows[k, SOURCES + zlib.crc32(repr(language).encode()) % LANGUAGES] = 1
        rows[k, SOURCES + LANGUAGES :] = [
            1.0,
            np.log1p(max(size or 0, 0)) / 10,
            np.log1p(len(lines)) / 5,
            np.log1p(len(text) / len(lines)) / 8,
            np.log1p(long) / 10,
            len(set(lines)) / len(lines),
            sum("|" in line or "\t" in line for line in lines) / len(lines),
            sum(line.rstrip().endswith((".", "!", "?", ":")) for line in lines) / len(lines),
        ]
    return rows


def _views(rows: list) -> list[np.ndarray]:
    texts = [r.text or "" for r in rows]
    one = [text_view(texts[k : k + 64]) for k in range(0, len(texts), 64)]
    return [np.vstack(one) if one else np.zeros((0, 0)), metadata_view(texts, [r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows])]


def _log_odds(view: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = view @ weights
    return scores[:, 1] - scores[:, 0]


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and intercept of a small logistic regression, by Newton's method with a ridge."""
    x, found = np.hstack([rows, np.ones((len(rows), 1))]), np.zeros(rows.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        hessian = (x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(found))
        found = found - np.linalg.solve(hessian, x.T @ (p - labels) + ridge * found)
    return found


@dataclass
class Model:
    weights: list[np.ndarray]  # of the two views
    platt: list[np.ndarray]  # slope and intercept of each view
    blend: np.ndarray  # of the calibrated log-odds, and an intercept

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        odds = np.stack([_log_odds(v, w) * p[0] + p[1] for v, w, p in zip(views, self.weights, self.platt, strict=True)], axis=1)
        return 1 / (1 + np.exp(-np.clip(odds @ self.blend[:-1] + self.blend[-1], -30, 30)))


def _confident(rows: DataFrame, known: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(doc_id, _row, odds0, odds1) of all unlabelled ``rows`` of which a view is CONFIDENT: its log-odds, whole texts.

    Numbers alone leave the tasks, so the labelled documents are taken off afterwards. Each row is summed up by itself,
    so that its odds do not depend on the rows beside it.
    """
    least, ways = np.log(CONFIDENT / (1 - CONFIDENT)), [w[:, 1] - w[:, 0] for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "text"):
                texts, languages, sources, sizes = (part.column(c).to_pylist() for c in COLUMNS[1:])
                views = [text_view(texts), metadata_view(texts, languages, sources, sizes)]
                odds = [(v * w).sum(axis=1) for v, w in zip(views, ways, strict=True)]
                sure = pa.array((np.abs(odds) >= least).any(axis=0))
                columns = [part.column("doc_id"), part.column("_row"), *map(pa.array, odds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "odds0", "odds1"]).filter(sure)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, _row long, odds0 double, odds1 double")
    return scored.join(known.select("doc_id"), "doc_id", "left_anti").distinct()


def _exchanged(rows: DataFrame, known: DataFrame, weights: list[np.ndarray], quota: tuple[int, int], taken: set[int]) -> list[tuple[int, int, list]]:
    """(taker, label, documents) of one round: of all unlabelled documents not yet ``taken`` those of which the other view
    is most confident. Each task hands over at most a quota of numbers; only the chosen documents' texts follow."""
    least, given = float(np.log(CONFIDENT / (1 - CONFIDENT))), []
    scored = saved(_confident(rows, known, weights), "co-training")
    for giver, taker in ((0, 1), (1, 0)):
        for label, sure in ((1, F.col(f"odds{giver}")), (0, -F.col(f"odds{giver}"))):
            free = scored.filter((sure >= least) & ~F.col("_row").isin(list(taken)))
            best = [r._row for r in free.orderBy(F.desc(sure), hash_order(F.col("doc_id")), "_row").limit(quota[label]).select("_row").collect()]
            taken.update(best)
            given.append((taker, label, best))
    discard(scored)
    chosen = [(k,) for _, _, best in given for k in best]
    if not chosen:
        return []
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, "_row long"))
    of = {r._row: r for r in rows.join(wanted, "_row").dropDuplicates(["_row"]).collect()}
    return [(taker, label, [of[k] for k in best]) for taker, label, best in given if best]


def co_train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model from documents and labels (doc_id, quality 0 or 1); None if the labels do not tell two kinds apart."""
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = documents.select(*COLUMNS).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    kinds = rows.select("doc_id").join(known, "doc_id").select("doc_id", (F.col("quality") > 0).cast("int").alias("good"))
    chosen, counts = sample_per_label(kinds, "doc_id", "good", SAMPLE)
    if len(counts) < 2:
        return None
    labelled = rows_of(rows, "doc_id", chosen, "good")
    truth = np.array([r.good for r in labelled])
    views = _views(labelled)
    aside = every_fifth(truth)
    if len(set(truth[aside].tolist())) < 2 or len(set(truth[~aside].tolist())) < 2:
        aside = np.zeros(len(truth), bool)
    train_x, train_y = [v[~aside] for v in views], [truth[~aside]] * 2
    share = counts[1] / (counts[0] + counts[1])
    quota = (max(1, round(EXCHANGED * (1 - share))), max(1, round(EXCHANGED * share)))
    hashed, taken = rows.withColumn("_row", F.xxhash64(*COLUMNS)), set()
    for _ in range(ROUNDS):
        weights = [follow_the_leader(x, y, 2) for x, y in zip(train_x, train_y, strict=True)]
        given = _exchanged(hashed, known, weights, quota, taken)
        if not given:
            break
        for taker, label, found in given:
            train_x[taker] = np.vstack([train_x[taker], _views(found)[taker]])
            train_y[taker] = np.append(train_y[taker], np.full(len(found), label))
    weights = [follow_the_leader(x, y, 2) for x, y in zip(train_x, train_y, strict=True)]
    fold = aside if aside.any() else ~aside
    odds = [_log_odds(v[fold], w) for v, w in zip(views, weights, strict=True)]
    platt = [_logistic(o[:, None], truth[fold], 0.1) for o in odds]
    calibrated = np.stack([o * p[0] + p[1] for o, p in zip(odds, platt, strict=True)], axis=1)
    blend = _logistic(calibrated, truth[fold], 0.1)
    # a rare kind has more than its share of the sample
    blend[-1] += np.log(share / (1 - share)) - np.log(truth.mean() / (1 - truth.mean()))
    return Model(weights, platt, blend)


def _scorer(model: Model | None, at: list[int]):
    """Scores of an Arrow batch whose columns ``at`` are text, lang, source and n_chars."""

    def scores(part: pa.RecordBatch) -> np.ndarray:
        texts, languages, sources, sizes = (part.column(k).to_pylist() for k in at)
        texts = [t or "" for t in texts]
        found = np.ones(len(texts)) if model is None else model.scores([text_view(texts), metadata_view(texts, languages, sources, sizes)])
        return np.where([bool(t.strip()) for t in texts], found, 0.0)

    return scores


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, keep) of every row of ``documents``: the chance of good quality, and whether it is KEEP_FROM or more."""
    scores = _scorer(model, [1, 2, 3, 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "text"):
                found = scores(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), pa.array(found >= KEEP_FROM)], names=["doc_id", "score", "keep"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(*COLUMNS).mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def without_low_quality(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents`` that score KEEP_FROM or more."""
    scores = _scorer(model, [documents.columns.index(c) for c in COLUMNS[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "text"):
                yield part.filter(pa.array(scores(part) >= KEEP_FROM))

    return documents.mapInArrow(run, documents.schema)
