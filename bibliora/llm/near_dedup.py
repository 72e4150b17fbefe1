"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document is the set of its distinct n-word shingles (fewer words: all as one; none: the empty set, linked with
nothing). Two documents are linked if their sets have a Jaccard similarity of at least ``percent`` / 100.

SuperMinHash gives every element a permutation of the registers and keeps, per register, the least of rank + random
fraction. As ranks within a permutation exclude each other, registers are negatively correlated and estimates vary
less than MinHash's. Here the permutation is (a * rank + b) mod REGISTERS, with a prime number of registers and a, b
from the element's hash: any two registers still get a uniformly random pair of ranks, which is all that the variance
depends on, and the register of a rank needs no table. Ranks are tried in order, for all elements at once, and a
document stops as soon as no register can fall any more: about one rank for a long text.

BANDS bands of ROWS registers each make two documents of similarity 0.8 candidates but for one case in
1 / (1 - 0.8**4)**24, 300,000.

Copies (equal sets) are one class, which its smallest doc_id represents, before any pair is formed. A bucket of a
band names its smallest member its head; first every member is verified against its head, which joins most of what
belongs together. A head with all that share a bucket with it is a family, and every candidate pair lies in one. Where
a family still has several groups, the members outside the largest are verified against all others, in blocks. So no
candidate between two groups is left out, and the pairs that are rows of a table number one per member and head.

Defined results: null text is as empty; ties and repeated rows (of one doc_id) fall into one class; an empty table
gives an empty result; columns other than the named ones are not read. A row whose doc_id is null has no component and
is kept; rows with one doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_roots
from .hot_keys import join_aggregate
from .words import gram_hashes, mix, slices, text_bytes, word_hashes, word_spans
from .workspace import discard, saved

REGISTERS, BANDS, ROWS, BLOCK = 97, 24, 4, 512


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after another, and where each text starts."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    counts = np.diff(first)
    found, texts = gram_hashes(words, n), np.repeat(np.arange(len(counts)), counts)
    whole = texts[: len(found)] == texts[n - 1 :][: len(found)] if len(found) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    few = [gram_hashes(words[first[k] : first[k + 1]], int(counts[k])) for k in short]
    hashes = np.concatenate([found[whole], *few])
    texts = np.concatenate([texts[: len(found)][whole], short]).astype(np.int64)
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[new], texts[new]
    return hashes, np.searchsorted(texts, np.arange(len(counts) + 1))


def superminhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SuperMinHash signatures of sets of 64-bit hashes: rank in the high bits of a register, fraction in the low 24."""
    many, m = len(first) - 1, REGISTERS
    signature = np.full(many * m, np.iinfo(np.int64).max)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(many), sizes)
    seed = mix(hashes + np.uint64(0x51ED270B))
    step = (seed % np.uint64(m - 1)).astype(np.int64) + 1
    at = ((seed >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    for rank in range(m):
        fraction = (mix(hashes + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)).astype(np.int64)
        np.minimum.at(signature, owner * m + at, rank << 24 | fraction)
        # elements go on only in texts with a register above every value of the next rank's start
        running = signature.reshape(many, m).max(axis=1) >= (rank + 1) << 24
        keep = running[owner]
        if not keep.any():
            break
        owner, step, at, hashes = owner[keep], step[keep], at[keep], hashes[keep]
        at = (at + step) % m
    return signature.reshape(many, m)


def _signed(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, p, q, bands): set size, 128-bit fingerprint of the set, and a key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1).astype(np.uint64))
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = shingle_sets(part.column("text"), n)
                sizes = np.diff(first)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(k)))]) for k in (0xA5A5A5A5, 0x3C3C3C3C3C)]
                p, q = (mix(s[first[1:]] - s[first[:-1]] + sizes.astype(np.uint64)) for s in sums)
                rows = superminhash(hashes, first)[:, : BANDS * ROWS].astype(np.uint64).reshape(len(sizes), BANDS, ROWS)
                keys = np.broadcast_to(salt, (len(sizes), BANDS))
                for k in range(ROWS):
                    keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, k])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(sizes.astype(np.int64)), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "p", "q", "bands"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, p long, q long, bands array<long>")


def _sets(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles): the full sets as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = shingle_sets(part.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "shingles"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"{side}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def _common_sizes(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 matrices over the elements that both have."""
    x, y = np.concatenate(some), np.concatenate(others)
    shared = np.intersect1d(x, y)
    rows = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (some, others)]
    places = [np.searchsorted(shared, v) for v in (x, y)]
    known = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for p, v in zip(places, (x, y), strict=True)]
    found = np.zeros((len(some), len(others)), np.float32)
    for at in range(0, len(shared), 4096):
        parts = []
        for sets, row, place, there in zip((some, others), rows, places, known, strict=True):
            now = there & (place >= at) & (place < at + 4096)
            bits = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
            bits[row[now], place[now] - at] = 1
            parts.append(bits)
        found += parts[0] @ parts[1].T
    return found.astype(np.int64)


def links_between_groups(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one family that have different roots, at least one for each linked pair of roots.

    families: (head, doc_id, root). In each family the members outside its largest root are outsiders; blocks of at
    most about BLOCK outsiders meet blocks of as many members, so that no task has a whole family, and all
    intersections of two blocks are counted at once. Pairs are never rows; what comes out is a link per two roots.
    """
    sizes = families.groupBy("head", "root").count()
    main = sizes.groupBy("head").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), (F.sum("count") - F.max("count")).alias("out")).filter("out > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = join_aggregate(families, main, "head").withColumn("outer", F.col("root") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    as_member = rows.select("head", "doc_id", "root", F.lit(False).alias("outer"), block("all").alias("m"), F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("o"))
    as_outer = rows.filter("outer").select("head", "doc_id", "root", "outer", F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("m"), block("out").alias("o"))

    def run(rows: pa.Table) -> pa.Table:
        outer = rows.column("outer").to_numpy()
        doc, root = rows.column("doc_id").to_numpy(), rows.column("root").to_numpy()
        lists = rows.column("shingles").combine_chunks()
        whole, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        of = lambda which: [whole[offsets[k] : offsets[k + 1]] for k in np.flatnonzero(which)]
        a = b = np.empty(0, np.int64)
        if outer.any() and not outer.all():
            common = _common_sizes(of(outer), of(~outer))
            size = np.diff(offsets)
            union = size[outer][:, None] + size[~outer][None, :] - common
            x, y = np.nonzero((100 * common >= percent * union) & (root[outer][:, None] != root[~outer][None, :]))
            _, first = np.unique(np.stack([root[outer][x], root[~outer][y]]), axis=1, return_index=True)
            a, b = doc[outer][x[first]], doc[~outer][y[first]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return as_member.unionByName(as_outer).join(sets, "doc_id").groupBy("head", "m", "o").applyInArrow(run, "a long, b long")


def near_duplicate_groups(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of ``documents`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included; kept marks the one row of a
    component that has it. text_hash is xxhash64 of the text, which tells rows of one doc_id from each other.
    """
    signed = saved(_signed(documents, n), "signatures")
    classes = saved(signed.filter("n_shingles > 0").groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "classes")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    buckets = (
        named.join(classes, (named.doc_id == classes.rep) & (named.n_shingles == classes.n_shingles) & (named.p == classes.p) & (named.q == classes.q), "left_semi")
        .select("doc_id", F.explode("bands").alias("bucket"))
        .distinct()
    )
    heads = buckets.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = saved(join_aggregate(buckets, heads, "bucket").filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = saved(_sets(texts, n), "shingles")
    links = saved(linked(pairs, sets, percent), "links")
    roots = component_roots(links)
    members = pairs.select(F.col("a").alias("head"), F.col("b").alias("doc_id")).union(pairs.select("a", "a").distinct())
    families = saved(members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("head", "doc_id", F.coalesce("root", "doc_id").alias("root")), "families")
    more = saved(links_between_groups(families, sets, percent), "links")
    if not more.isEmpty():
        roots = component_roots(links.union(more))
    discard(pairs, sets, links, families, more)
    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "p", "q", F.coalesce("root", "rep").alias("root"))
    return (
        signed.drop("bands")
        .join(of_class, ["n_shingles", "p", "q"], "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), "text_hash")
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
    )
