"""Ranked lexical search: every document is ranked for each item, exactly, by a hierarchical max tree over documents.

A first pass turns each document into the postings of the items' terms. What a term adds to a document's score does not
depend on the item, so a tree can be laid over the documents of a shard: for each term and each range of documents it
has the largest addend in the range; ranges have FAN ranges or documents below them. The sum of an item's terms over a
range bounds every score in it. The search of an item opens the range of the highest bound first and stops when no
range left can reach the last place; a range whose bound equals it is opened, because a smaller key wins ties. Shards of
a task come one after another and keep what has been found, so that later trees are mostly cut at their top.

Defined results: every row of ``documents`` is a document, so rows with one key may each have a place; a null text or
one without terms has no score; a null key comes after all others among ties; items with null text or no terms have no
rows; each row of ``items`` is an item; other columns are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .terms import LETTERS_AND_DIGITS, terms_of
from .words import slices
from .workspace import Collected, discard, saved

SLICE_BYTES = 3 << 20
#: Children of a range, and ranges opened together if their bounds are among the highest and within a part of the highest.
FAN, BEAM, WITHIN = 32, 16, 8
#: A shard of the tree ends with so many documents or postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = FAN**3, 3_000_000
#: Items are answered in blocks of at most so many items and terms of them; an item of more terms is a block by itself.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000
_LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """Items asked together: their keys, their terms as places in ``terms``, which are all different terms of the block."""

    keys: list
    asked: list[np.ndarray]
    terms: pa.Array


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The items that have terms, block by block; no more than a block is on the driver at once."""
    keys, lists, many = [], [], 0
    for row in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        terms, _ = terms_of(pa.array([row[1]], pa.string()), LETTERS_AND_DIGITS)
        terms = terms.unique()
        if not len(terms):
            continue
        if keys and (len(keys) >= BLOCK_ITEMS or many + len(terms) > BLOCK_TERMS):
            yield _block(keys, lists)
            keys, lists, many = [], [], 0
        keys.append(row[0])
        lists.append(terms)
        many += len(terms)
    if keys:
        yield _block(keys, lists)


def _block(keys: list, lists: list[pa.Array]) -> Block:
    every = pa.concat_arrays(lists).unique()
    return Block(keys, [np.sort(pc.index_in(terms, value_set=every).to_numpy()) for terms in lists], every)


def postings(documents: DataFrame, terms: pa.Array, key: str, text: str) -> DataFrame:
    """(key, n, terms, counts) of every document with a term: n counts its terms with repeats, the lists are of asked ones."""
    width = max(len(terms), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found, first = terms_of(part.column(text), LETTERS_AND_DIGITS)
                number = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy()
                place = np.repeat(np.arange(part.num_rows), np.diff(first))
                pairs, counts = np.unique((place * width + number)[number >= 0], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(part.num_rows + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (pairs % width, counts)]
                rows = pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(np.diff(first)), *lists], names=["key", "n", "terms", "counts"])
                yield rows.filter(pc.greater(rows.column("n"), 0))

    return documents.select(key, text).mapInArrow(run, "key long, n long, terms array<int>, counts array<int>")


class Tree:
    """For each term and range of documents of a shard the largest addend; levels[0] has the documents of the lowest ranges."""

    def __init__(self, keys: np.ndarray, document: np.ndarray, term: np.ndarray, addend: np.ndarray, width: int) -> None:
        self.keys, self.width, self.levels = keys, width, []
        child, many = document, len(keys)
        while True:
            at = (child // FAN) * width + term
            order = np.argsort(at, kind="stable")
            at, child, addend = at[order], child[order], addend[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            self.levels.append((at[first], np.append(first, len(at)), child, addend))
            many = -(-many // FAN)
            child, term, addend = at[first] // width, at[first] % width, np.maximum.reduceat(addend, first) if len(first) else addend
            if many <= 1:
                self.top = (term, addend)
                return

    def bound(self, asked: np.ndarray) -> int:
        """The bound of the range of all documents."""
        term, addend = self.top
        if not len(term):
            return 0
        at = np.minimum(np.searchsorted(term, asked), len(term) - 1)
        return int(addend[at][term[at] == asked].sum())

    def opened(self, level: int, ranges: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of some ranges of a level, and the sums over the asked terms: bounds, or scores at level 0."""
        at, first, child, addend = self.levels[level]
        wanted = (ranges[:, None] * self.width + asked).ravel()
        place = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        place = place[at[place] == wanted]
        start, size = first[place], first[place + 1] - first[place]
        rows = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        children, where = np.unique(child[rows], return_inverse=True)
        sums = np.zeros(len(children), np.int64)
        np.add.at(sums, where, addend[rows])
        return children, sums


@dataclass
class Best:
    """The k best of what has been seen, best first: scores and keys."""

    k: int
    scores: np.ndarray
    keys: np.ndarray

    @property
    def bar(self) -> int:
        """What a score must reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= self.bar
        scores, keys = np.concatenate([self.scores, scores[good]]), np.concatenate([self.keys, keys[good]])
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]


def search_tree(tree: Tree, asked: np.ndarray, best: Best) -> int:
    """Put the documents of a tree that belong there into ``best``; returns how many ranges had to be opened."""
    top, count = len(tree.levels) - 1, 0
    heap = [(-tree.bound(asked), top, 0)]
    while heap and -heap[0][0] >= best.bar:
        bound, level, number = heapq.heappop(heap)
        ranges, least = [number], max(best.bar, -bound - -bound // WITHIN)
        while heap and len(ranges) < BEAM and heap[0][1] == level and -heap[0][0] >= least:
            ranges.append(heapq.heappop(heap)[2])
        count += len(ranges)
        children, sums = tree.opened(level, np.array(ranges), asked)
        if level == 0:
            best.add(sums, tree.keys[children])
        else:
            good = sums >= best.bar
            for child, value in zip(children[good].tolist(), sums[good].tolist(), strict=True):
                heapq.heappush(heap, (-value, level - 1, child))
    return count


def addends(term: np.ndarray, count: np.ndarray, n: np.ndarray, weights: np.ndarray, total: int, length: int) -> np.ndarray:
    """What each posting adds to the score of its document; n is the document's number of terms, by posting."""
    whole, rest = divmod(90 * total, length)  # (90 * n * total) div length without its product
    if len(n) and int(n.max()) * max(rest, whole) < 1 << 62:
        m = 10 + n * whole + n * rest // length
    else:
        m = np.array([10 + 90 * int(x) * total // length for x in n.tolist()], np.int64)
    count = count.astype(np.int64)
    return weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, documents, many = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            to = min(batch.num_rows, at + SHARD_DOCUMENTS - documents, max(at + 1, int(np.searchsorted(sizes, before + SHARD_POSTINGS - many, "right"))))
            kept.append(batch.slice(at, to - at))
            documents, many, at = documents + to - at, many + int(sizes[to - 1]) - before, to
            if documents >= SHARD_DOCUMENTS or many >= SHARD_POSTINGS:
                yield pa.Table.from_batches(kept)
                kept, documents, many = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def _tree(shard: pa.Table, weights: np.ndarray, total: int, length: int) -> Tree:
    shard = shard.combine_chunks()
    terms = shard["terms"].combine_chunks()
    document = np.repeat(np.arange(shard.num_rows), pc.list_value_length(terms).to_numpy())
    term, count = terms.flatten().to_numpy().astype(np.int64), shard["counts"].combine_chunks().flatten().to_numpy()
    addend = addends(term, count, shard["n"].to_numpy()[document], weights, total, length)
    keys = pc.fill_null(shard["key"], _LAST).to_numpy()
    real = addend > 0
    return Tree(keys, document[real], term[real], addend[real], len(weights))


def rank(documents: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score): for each item the ``k`` documents of the highest scores above 0, ties by smaller key.

    Postings are packed by document and never shuffled; each task sends at most k rows of an item on.
    """
    spark = documents.sparkSession
    kind = items.schema[item].dataType.simpleString()
    found = Collected(spark, f"`{item}` {kind}, rank int, `{key}` long, score long", "lexical-search")
    for block in item_blocks(items, item, text):
        table = saved(postings(documents, block.terms, key, text), "postings")
        total, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        seen = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * seen.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
        found.add(_ranked(table, block, weights, total, length, k, item, key, kind))
        discard(table)
    return found.table()


def _ranked(table: DataFrame, block: Block, weights: np.ndarray, total: int, length: int, k: int, item: str, key: str, kind: str) -> DataFrame:
    asked = block.asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]
        for shard in _shards(batches):
            tree = _tree(shard, weights, total, length)
            for terms, own in zip(asked, best, strict=True):
                search_tree(tree, terms, own)
        number = np.repeat(np.arange(len(asked), dtype=np.int32), [len(b.keys) for b in best])
        keys = np.concatenate([b.keys for b in best])
        columns = [pa.array(number), pa.array(keys, mask=keys == _LAST), pa.array(np.concatenate([b.scores for b in best]))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "key", "score"])

    spark = table.sparkSession
    places = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = table.mapInArrow(run, "item int, key long, score long").withColumn("rank", F.row_number().over(places)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.keys)), f"item int, name {kind}")
    return best.join(names, "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")
