"""Removal of word passages that an earlier document has, with an FM-index per shard.

A window is ``window`` consecutive words. A word goes if a window that covers it also starts in a document with a
smaller doc_id.

1. Every window has an anchor, the least hash among its word 12-grams. Consecutive windows with one anchor are a run,
   and the words under a run are its passage. Equal windows have equal anchors, so only runs whose anchor occurs in
   two documents matter. An anchor that very many runs have (a common line) would bring them all to one shard: so such
   grams, at most MOST_HOT of them, are passed over, wherever a window has any other gram.
2. Passages that are the same word for word count once, for the smallest doc_id: what is found for one holds for its
   copies, and all of a later copy goes.
3. Different passages meet by anchor in shards. In a shard documents are halved, quartered and so on by doc_id: the
   passages of each first half are put into an FM-index (wavelet tree over the Burrows-Wheeler transform, real words
   as symbols), and those of the second half are streamed backward through it, if the index has the words that all
   windows of the passage share. Matching statistics tell for each place how long the longest match is, and its interval the smallest doc_id; matches of ``window`` words and more in
   smaller doc_ids are the intervals reported. Every two documents of an anchor meet once. No document is streamed
   through an index that holds it, and a passage that is found whole is not looked for, or in, again.
4. Every document removes the words that its windows cover, judged on the input.

Texts are shuffled once, by doc_id; the exchange serves all joins. Shards compare words themselves, copies of whole
passages are told by a 64-bit hash.

Defined results: a null or empty text has no words and the digest of the empty text; rows with one doc_id are not
earlier than each other; rows with a null doc_id are never removed from and never earlier; an empty table gives an
empty result; rows with one doc_id and different texts are judged each by itself; other columns are not read by ``repeated_passages`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .hot_keys import join_aggregate
from .words import gram_hashes, slices, span_hashes, text_bytes, word_hashes, word_spans
from .workspace import discard, saved

WINDOW, GRAM, LONGEST_RUN = 50, 12, 64
#: Only where windows meet depends on these: an anchor of over HOT runs is passed over, of which there may be MOST_HOT;
#: a shard's passages are indexed in parts of whole anchors with about SHARD_WORDS words.
HOT, MOST_HOT, SHARD_WORDS = 2000, 100_000, 600_000
RUN = "anchor long, doc_id long, version long, start int, n int, passage long"


def _words(column: pa.Array, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    return data, starts, ends, first, word_hashes(data, starts, ends) if hashed else np.empty(0, np.uint64)


def _least_within(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values."""
    done = 1
    while done < span:
        more = min(done, span - done)
        values = np.minimum(values[: len(values) - more], values[more:])
        done += more
    return values


def anchor_runs(words: np.ndarray, first: np.ndarray, window: int = WINDOW, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, as arrays: anchor, text, start (in words of the text), number of windows.

    With ``hot`` (sorted hashes of grams) only the windows whose least gram is among them, by their least other gram.
    """
    grams = gram_hashes(words, GRAM)
    if len(words) < window:
        return (np.empty(0, np.int64),) * 4
    anchors = _least_within(grams, window - GRAM + 1)
    at = np.arange(len(anchors))
    text = np.searchsorted(first, at, "right") - 1
    inside = at + window <= first[text + 1]
    if hot is not None:
        last = np.uint64(2**64 - 1)
        others = _least_within(np.where(_among(grams, hot), last, grams), window - GRAM + 1)
        inside &= _among(anchors, hot)
        anchors = np.where(others == last, anchors, others)
    at, text, anchors = at[inside], text[inside], anchors[inside]
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    head_of = np.repeat(heads, np.diff(np.append(heads, len(at))))
    new |= (np.arange(len(at)) - head_of) % LONGEST_RUN == 0
    heads = np.flatnonzero(new)
    return anchors[heads].view(np.int64), text[heads], at[heads] - first[text[heads]], np.diff(np.append(heads, len(at)))


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among some sorted ones."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _runs(documents: DataFrame, window: int, hot: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, first, words = _words(part.column("text"))
                anchor, text, start, n = anchor_runs(words, first, window, hot)
                at = first[text] + start
                passage = span_hashes(words, at, at + n + window - 1).view(np.int64)
                columns = [pa.array(anchor), *(part.column(c).take(pa.array(text)) for c in ("doc_id", "version")), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(passage)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "version", "start", "n", "passage"])

    return documents.mapInArrow(run, RUN)


def _all_runs(texts: DataFrame, window: int) -> list[DataFrame]:
    """Tables that together have the runs of all texts."""
    runs = saved(_runs(texts, window), "runs")
    counts = runs.groupBy("anchor").count()
    most = max(HOT, runs.count() // MOST_HOT)  # so at most MOST_HOT anchors have more
    hot = np.sort(np.array([r.anchor for r in counts.filter(F.col("count") > most).collect()], np.int64).view(np.uint64))
    if not len(hot):
        return [runs]
    hot_anchors = F.broadcast(texts.sparkSession.createDataFrame([(int(h),) for h in hot.view(np.int64)], "anchor long"))
    return [runs.join(hot_anchors, "anchor", "left_anti"), saved(_runs(texts, window, hot), "runs")]


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, version, passage, start, n, words) of each run; words only where this task has not just sent them."""
    sent: set[tuple[int, int]] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            data, starts, ends, first, _ = _words(part.column("text"), hashed=False)
            data = data.tobytes()
            lists = part.column("runs")
            runs = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            start, n = runs.field("start").to_numpy(), runs.field("n").to_numpy()
            at = first[row] + start
            (docs, versions), names = (part.column(c).take(pa.array(row)) for c in ("doc_id", "version")), runs.field("passage")
            contents = []
            for key, a, b in zip(zip(docs.to_pylist(), names.to_pylist(), strict=True), starts[at].tolist(), ends[at + n + window - 2].tolist(), strict=True):
                contents.append(None if key in sent else data[a:b])
                sent.add(key)
            if len(sent) > 500_000:
                sent.clear()
            columns = [runs.field("anchor"), docs, versions, names, runs.field("start"), runs.field("n"), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "version", "passage", "start", "n", "words"])


def _by_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole anchors with passages of about SHARD_WORDS words (of LONGEST_RUN windows at most)."""
    kept: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        while kept or batch.num_rows:
            before = kept[-1].column("anchor")[-1].as_py() if kept else None
            cuts = np.flatnonzero(anchor != np.append(before if kept else anchor[:1], anchor[:-1])) if len(anchor) else anchor
            sizes = np.cumsum(batch.column("n").to_numpy().astype(np.int64) + WINDOW)
            cuts = cuts[(many + np.append(0, sizes)[cuts]) >= SHARD_WORDS]
            if not len(cuts):
                if batch.num_rows:
                    kept.append(batch)
                    many += int(sizes[-1])
                break
            yield pa.Table.from_batches([*kept, batch.slice(0, int(cuts[0]))])
            kept, many = [], 0
            batch, anchor = batch.slice(int(cuts[0])), anchor[int(cuts[0]) :]
    if kept:
        yield pa.Table.from_batches(kept)


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Intervals of words to remove, from all runs of the anchors that this partition has, in order of anchor, doc_id
    and passage, those with words first."""
    for table in _by_anchors(batches):
        anchor, doc, name, start, n = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "passage", "start", "n"))
        new_doc, new = np.ones(len(doc), bool), np.ones(len(doc), bool)
        new_doc[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        new[1:] = new_doc[1:] | (name[1:] != name[:-1])
        heads, passage = np.flatnonzero(new), np.cumsum(new) - 1
        contents = table.column("words").take(pa.array(heads)).to_pylist()
        found = _found(contents, anchor[heads], np.cumsum(new_doc)[heads], doc[heads], n[heads], window)
        # every run's windows, and which of them an earlier document has
        before = np.cumsum(n[heads]) - n[heads]
        run = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        repeated = found[before[passage[run]] + offset]
        opens = repeated & ~np.concatenate([[False], repeated[:-1] & (run[1:] == run[:-1])])
        closes = repeated & ~np.concatenate([repeated[1:] & (run[1:] == run[:-1]), [False]])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        versions = table.column("version").take(pa.array(run[a])).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(doc[run[a]]), versions, pa.array((start[run[a]] + offset[a]).astype(np.int32)), pa.array((start[run[b]] + offset[b] + window).astype(np.int32))], names=["doc_id", "version", "a", "b"])


def _found(contents: list[bytes], anchor: np.ndarray, number: np.ndarray, doc: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which windows of the passages, one passage after another, a smaller doc_id has. ``number`` counts documents up."""
    known: dict[bytes, int] = {}
    numbered = [[known.setdefault(w, len(known)) for w in content.split()] for content in contents]
    codes = np.fromiter((c for some in numbered for c in some), np.int64)
    size = n.astype(np.int64) + window - 1
    first = np.cumsum(size) - size
    group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
    lowest = np.minimum.reduceat(number, np.flatnonzero(np.diff(group, prepend=-1)))
    place = number - lowest[group]  # of the document among those of its anchor
    last = np.maximum.reduceat(place, np.flatnonzero(np.diff(group, prepend=-1)))[group]
    found = np.zeros(int(n.sum()), bool)
    before = np.cumsum(n) - n
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(int(last.max(initial=0)).bit_length() - 1, -1, -1):
        half = place >> level
        open_ = ~np.logical_and.reduceat(found, before)
        levels.append((np.flatnonzero(open_ & (half % 2 == 0) & (half < last >> level)), np.flatnonzero(open_ & (half % 2 == 1))))
        if level and sum(int(size[x].sum()) for both in levels for x in both) < SHARD_WORDS:
            continue
        # the levels so far in one index, in which words of different levels are different symbols
        stored, streamed = (np.concatenate([both[k] for both in levels]) for k in (0, 1))
        apart = [np.repeat(np.arange(len(levels)) * len(known), [len(both[k]) for both in levels]) for k in (0, 1)]
        levels = []
        if not len(stored) or not len(streamed):
            continue
        inside = np.repeat(apart[0], size[stored]) + codes[_places(first[stored], size[stored])]
        alphabet = np.zeros(int(inside.max()) + 1, np.int64)
        alphabet[inside] = 1
        alphabet *= np.cumsum(alphabet)
        index = FMIndex(alphabet[inside], np.append(0, np.cumsum(size[stored])), doc[stored], window)

        def symbols(starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray, alphabet: np.ndarray = alphabet) -> tuple[np.ndarray, np.ndarray]:
            there = np.repeat(tags, sizes) + codes[_places(starts, sizes)]
            return np.where(there < len(alphabet), alphabet[np.minimum(there, len(alphabet) - 1)], 0), np.append(0, np.cumsum(sizes))

        core = np.maximum(window + 1 - n[streamed].astype(np.int64), 0)  # the words that all windows of a passage share
        kept = index.occurs(*symbols(first[streamed] + n[streamed] - 1, core, apart[1]))
        streamed, tags = streamed[kept], apart[1][kept]
        length, row = index.matching_statistics(*symbols(first[streamed], size[streamed], tags), window)
        owner = index.least_owners(length, row, np.iinfo(np.int64).max)
        at = _places(np.cumsum(size[streamed]) - size[streamed], n[streamed])
        repeated = _places(before[streamed], n[streamed])[owner[at] < np.repeat(doc[streamed], n[streamed])]
        found[repeated] = True
    return found


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every start, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def repeated_passages(documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, intervals) of the texts with words to remove, as word intervals [a, b) that may overlap; and the
    texts read (doc_id, text, version). The version, a hash of the text, tells different texts of one doc_id apart."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version")).filter("doc_id IS NOT NULL")
    tables = _all_runs(texts, window)
    runs = reduce(DataFrame.unionByName, tables)
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = saved(join_aggregate(runs, anchors.select("anchor"), "anchor"), "shared-runs")
    discard(*tables)
    earliest = shared.groupBy("passage").agg(F.min("doc_id").alias("lo"))
    rows = saved(join_aggregate(shared, earliest, "passage"), "passages")
    discard(shared)
    firsts = rows.filter("doc_id = lo")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), firsts.count() // 50_000)
    lists = firsts.groupBy("doc_id", "version").agg(F.collect_set(F.struct("anchor", "passage", "start", "n")).alias("runs"))
    passages = texts.join(lists, ["doc_id", "version"]).mapInArrow(lambda b: _passages(b, window), "anchor long, doc_id long, version long, passage long, start int, n int, words binary")
    sharded = passages.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "passage", F.isnull("words"))
    found = sharded.mapInArrow(lambda b: _shard(b, window), "doc_id long, version long, a int, b int")
    copies = rows.filter("doc_id > lo").select("doc_id", "version", F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"))
    return found.union(copies).groupBy("doc_id", "version").agg(F.collect_set(F.struct("a", "b")).alias("intervals")), texts


def _kept_words(part: pa.RecordBatch, column: str = "intervals") -> Iterator[tuple[list[bytes], int]]:
    """The words that each text keeps, and how many it has."""
    intervals = part.column(column).to_pylist()
    for text, cuts in zip(part.column("text").to_pylist(), intervals, strict=True):
        words = (text or "").encode().split()
        if cuts:
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, [c["a"] for c in cuts], 1)
            np.add.at(depth, [c["b"] for c in cuts], -1)
            gone = np.cumsum(depth)[:-1] > 0
            yield [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)
        else:
            yield words, len(words)


def removal_digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``documents``."""
    intervals, texts = repeated_passages(documents, window)
    unnamed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NULL")
    rows = texts.join(intervals, ["doc_id", "version"], "left").unionByName(unnamed, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, removed, digests = [], [], []
                for kept, many in _kept_words(part):
                    counts.append(many)
                    removed.append(many - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with its texts after removal: texts that lose words become their kept words joined by spaces."""
    intervals, _ = repeated_passages(documents, window)
    names = documents.columns
    at = names.index("text")
    found = intervals.toDF("__doc", "__version", "__intervals")
    same = (documents["doc_id"].cast("long") == F.col("__doc")) & (F.xxhash64(documents["text"]) == F.col("__version"))
    rows = documents.join(found, same, "left").drop("__doc", "__version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                cut = part.column("__intervals").is_valid().to_pylist()
                kept = [b" ".join(k).decode() if c else t for (k, _), c, t in zip(_kept_words(part, "__intervals"), cut, texts, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    return rows.mapInArrow(run, documents.schema)
