"""A content-addressed store of token-id streams.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last WINDOW ids has MASK_BITS
zero bits, so equal passages give equal chunks wherever they stand. The store is a folder of Parquet tables:

- ``new/is_recipe=false``, the chunks: digest, ids (little-endian unsigned integers of ``width`` bytes, zstd-compressed), length.
  A chunk is stored once however many documents have it; rows are spread by digest.
- ``recipes/is_manifest=false``: doc_id, n_tokens, the digests of its chunks in order, and the Merkle root over them.
  Files and rows are in ascending doc_id order, and that is the order of the stream.
- ``manifest``: per recipe file its doc_id range, documents, tokens, the Merkle root over its recipes' roots (which the
  task that writes the file computes as rows pass), the stream position where it starts, and how many files there are.

Writing encodes each text once and shuffles each task's different chunks once. ``read_tokens`` joins recipes with
chunks into whole streams; ``read_checksums`` gathers no stream, but combines the CRC-32 of the chunks, each read and
verified once, by the CRC's linearity. Both verify chunks against their digests, recipes against their Merkle roots,
and files against the manifest's documents, tokens and roots, and fail if a chunk, recipe or file is missing or changed.

Defined results: a null or empty text is the end id alone; documents with one doc_id follow each other in any order,
and a null doc_id comes first; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_automaton import UNSETTLED, WORDS, byte_letters
from .words import powers, slices

WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 128, 8192
#: Ids of words are remembered until the words and ids take so many bytes together, each word with so many for its places in tables.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 150
CHUNK = "digest binary, ids binary, length int"
RECIPE = "doc_id long, n_tokens long, recipe array<binary>, root binary"
MANIFEST = "part int, first_doc long, last_doc long, documents long, tokens long, file_root binary"


class _Numbers(dict):
    """Numbers words as they turn up, and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.size = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        self.size += len(word) + ENTRY_BYTES
        return number


class IdEncoder:
    """The tokenizers library over many texts, for tokenizers that drop white space and mark the ends of words.

    Texts of settled letters are split into words, and the library's model encodes each different word once while a
    bounded table lasts. All other texts go to the library as they are.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.library.no_truncation()
        self.library.no_padding()
        self.word_ids = self.library.model.tokenize
        self.letters = {b: letter for b, letter in byte_letters().items() if chr(b) != letter}
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.pool, self.first = _Numbers(), np.empty(0, self.kind), np.zeros(1, np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _learn(self) -> None:
        """Encode the words that are new, written in the letters of byte-level vocabularies."""
        words, self.numbers.fresh = self.numbers.fresh, []
        if words:
            ids: list[int] = []
            ends = []
            for word in words:
                if not (word.isascii() and word.isprintable()):
                    word = word.encode().decode("latin-1").translate(self.letters)
                ids += [token.id for token in self.word_ids(word)]
                ends.append(len(ids))
            self.first = np.concatenate([self.first, np.array(ends, np.int64) + len(self.pool)])
            self.pool = np.concatenate([self.pool, np.array(ids, self.kind)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.numbers.size + self.pool.nbytes > CACHE_BYTES:
            self._forget()
        number = self.numbers.__getitem__
        found: list[np.ndarray] = []
        for text in texts:
            if "<|" in text or not (text.isascii() or not UNSETTLED.search(text)):
                found.append(self._library(text).astype(self.kind))
            else:
                found.append(np.fromiter(map(number, WORDS.findall(text.lower())), np.int32))
        self._learn()
        return [f if f.dtype == self.kind else self._ids(f) for f in found]

    def _ids(self, words: np.ndarray) -> np.ndarray:
        starts, sizes = self.first[words], self.first[words + 1] - self.first[words]
        before = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> IdEncoder:
    return IdEncoder(path, width)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of an id stream; the last is its length."""
    ends = []
    if len(ids) > WINDOW:
        up, down = powers(len(ids) + 1)
        sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        rolling = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(ids) - WINDOW + 1] * np.uint64(0xBF58476D1CE4E5B9)
        ends = (np.flatnonzero(rolling >> np.uint64(64 - MASK_BITS) == 0) + WINDOW).tolist()
    found, last = [], 0
    for end in [*ends, len(ids)]:
        while end - last > MOST:
            last += MOST
            found.append(last)
        if end - last >= LEAST or end == len(ids) > last:
            last = end
            found.append(end)
    return np.array(found, np.int64)


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary Merkle tree over digests; an odd one is carried up."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class MerkleTree:
    """The root that ``merkle_root`` gives, for digests that come one by one: a digest per level is kept."""

    def __init__(self) -> None:
        self.full: list[tuple[int, bytes]] = []

    def add(self, digest: bytes) -> None:
        height = 0
        while self.full and self.full[-1][0] == height:
            digest, height = hashlib.sha256(self.full.pop()[1] + digest).digest(), height + 1
        self.full.append((height, digest))

    def root(self) -> bytes:
        if not self.full:
            return merkle_root([])
        found = self.full[-1][1]
        for _, left in self.full[-2::-1]:
            found = hashlib.sha256(left + found).digest()
        return found


@lru_cache(maxsize=64)
def _zeros_operator(bits: int) -> tuple[int, ...]:
    """The CRC-32 register after 2**bits zero bytes, as a linear map: the images of its 32 bits."""
    if bits == 0:
        rows = []
        for k in range(32):
            value = 1 << k
            for _ in range(8):
                value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
            rows.append(value)
        return tuple(rows)
    half = _zeros_operator(bits - 1)
    return tuple(_apply(half, row) for row in half)


def _apply(operator: tuple[int, ...], value: int) -> int:
    found, k = 0, 0
    while value:
        if value & 1:
            found ^= operator[k]
        value >>= 1
        k += 1
    return found


@lru_cache(maxsize=2 * MOST)
def _shift_operator(length: int) -> tuple[int, ...]:
    """The CRC-32 register after ``length`` zero bytes, as a linear map."""
    rows, bits = [1 << k for k in range(32)], 0
    while length:
        if length & 1:
            rows = [_apply(_zeros_operator(bits), row) for row in rows]
        length >>= 1
        bits += 1
    return tuple(rows)


def crc_joined(crc: int, after: int, length: int) -> int:
    """The CRC-32 of two byte strings after each other, from the CRC of each and the length of the second."""
    return _apply(_shift_operator(length), crc) ^ after


def _chunked(documents: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Recipes and chunks in one table: rows with doc_id recipe, others a chunk that this task has not given yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        kind, compress = np.dtype(f"<u{width}"), zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                counts, recipes, digests, packed, lengths = [], [], [], [], []
                for ids in encoder(path, width).encode([t or "" for t in part.column("text").to_pylist()]):
                    ids = np.append(ids, kind.type(end_id))
                    recipe, at = [], 0
                    for to in cut_points(ids).tolist():
                        raw = ids[at:to].tobytes()
                        digest = hashlib.sha256(raw).digest()
                        recipe.append(digest)
                        if digest not in given:
                            given.add(digest)
                            digests.append(digest)
                            packed.append(compress(raw))
                            lengths.append(to - at)
                        at = to
                    counts.append(len(ids))
                    recipes.append(recipe)
                none = [None] * len(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array([True] * len(counts)), pa.array([False] * len(digests))]),
                        pa.concat_arrays([part.column("doc_id"), pa.array(none, pa.int64())]),
                        pa.array(counts + none, pa.int64()),
                        pa.array(recipes + none, pa.list_(pa.binary())),
                        pa.array([merkle_root(r) for r in recipes] + none, pa.binary()),
                        pa.array([None] * len(counts) + digests, pa.binary()),
                        pa.array([None] * len(counts) + packed, pa.binary()),
                        pa.array([None] * len(counts) + lengths, pa.int32()),
                    ],
                    names=["is_recipe", "doc_id", "n_tokens", "recipe", "root", "digest", "ids", "length"],
                )

    schema = f"is_recipe boolean, {RECIPE}, {CHUNK}"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def write_store(documents: DataFrame, folder: str, path: str, end_id: int, width: int = 2, parts: int | None = None) -> None:
    """Encode ``documents`` (doc_id, text) and write the store to ``folder``. ``width``: bytes of an id, 2 or 4."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()  # of one partition, to which all copies of a digest come
        for batch in batches:
            fresh = []
            for digest in batch.column("digest").to_pylist():
                fresh.append(digest is None or digest not in given)
                given.add(digest)
            yield batch.filter(pa.array(fresh))

    mixed = _chunked(documents, path, end_id, width)
    spread = mixed.repartition(parts, F.xxhash64("digest", "doc_id"))
    spread.mapInArrow(once, spread.schema).write.partitionBy("is_recipe").parquet(f"{folder}/new")
    ordered = _new(spark, folder, RECIPE).filter("is_recipe").drop("is_recipe").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(_numbered, f"{RECIPE}, place long, {MANIFEST}, is_manifest boolean").write.partitionBy("is_manifest").parquet(f"{folder}/recipes")
    files = spark.read.schema(f"{MANIFEST}, is_manifest boolean").parquet(f"{folder}/recipes").filter("is_manifest").drop("is_manifest")
    start = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files.withColumn("start", start).withColumn("width", F.lit(width)).withColumn("files", F.count("*").over(Window.partitionBy("width"))).coalesce(1).write.parquet(f"{folder}/manifest")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recipes of one file with their places, and then the row of the manifest on them."""
    context = TaskContext.get()
    part, tree, many, tokens, docs = context.partitionId() if context else 0, MerkleTree(), 0, 0, []
    kinds = {"part": pa.int32(), "first_doc": pa.int64(), "last_doc": pa.int64(), "documents": pa.int64(), "tokens": pa.int64(), "file_root": pa.binary()}
    recipe = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.list_(pa.binary())), ("root", pa.binary())]
    names = [*[n for n, _ in recipe], "place", *kinds, "is_manifest"]
    for batch in batches:
        if not batch.num_rows:
            continue
        for root in batch.column("root").to_pylist():
            tree.add(root)
        seen = batch.column("doc_id").drop_null()
        docs = [docs[0] if docs else seen[0].as_py(), seen[-1].as_py()] if len(seen) else docs
        place = (part << 40) + many + np.arange(batch.num_rows)
        many, tokens = many + batch.num_rows, tokens + int(batch.column("n_tokens").to_numpy().sum())
        none = [pa.nulls(batch.num_rows, k) for k in kinds.values()]
        none[0] = pa.array(np.full(batch.num_rows, part, np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in recipe), pa.array(place), *none, pa.array([False] * batch.num_rows)], names=names)
    if many:
        values = [part, *(docs or [None, None]), many, tokens, tree.root()]
        row = [*(pa.nulls(1, k) for _, k in recipe), pa.nulls(1, pa.int64()), *(pa.array([v], k) for v, k in zip(values, kinds.values(), strict=True)), pa.array([True])]
        yield pa.RecordBatch.from_arrays(row, names=names)


def _new(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, is_recipe boolean").parquet(f"{folder}/new")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _new(spark, folder, CHUNK).filter("NOT is_recipe").drop("is_recipe")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes with ``start``, the stream position of each document; files that do not agree with the manifest fail."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files, expected = manifest.agg(F.count("*"), F.max("files")).first()
    if files != (expected or 0):
        raise ValueError(f"the manifest of {folder} has {files} of {expected} files")
    recipes = spark.read.schema(f"{RECIPE}, part int, place long, is_manifest boolean").parquet(f"{folder}/recipes").filter("NOT is_manifest").drop("is_manifest")
    known = manifest.select(F.col("part").alias("_part"), "start", "documents", "tokens", "file_root")
    both = recipes.join(known, recipes["part"] == known["_part"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, many, tokens, wanted = None, MerkleTree(), 0, 0, None

        def close() -> None:
            if part is not None and (many, tokens, tree.root()) != wanted:
                raise ValueError(f"recipe file {part} has lost or changed documents")

        for batch in batches:
            starts = []
            columns = [batch.column(c).to_pylist() for c in ("part", "_part", "n_tokens", "root", "start", "documents", "tokens", "file_root")]
            for own, listed, n, root, start, documents, all_tokens, file_root in zip(*columns, strict=True):
                if own is None or listed is None:
                    raise ValueError(f"recipe file {listed if own is None else own} is missing, or not in the manifest")
                if own != part:
                    close()
                    part, tree, many, tokens, wanted = own, MerkleTree(), 0, 0, (documents, all_tokens, file_root)
                tree.add(root)
                starts.append(start + tokens)
                many, tokens = many + 1, tokens + n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "recipe", "root", "place")), pa.array(starts, pa.int64())], names=["doc_id", "n_tokens", "recipe", "root", "place", "start"])
        close()

    return both.sortWithinPartitions("part", "place").mapInArrow(run, f"{RECIPE}, place long, start long")


def _with_chunks(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """Each document's columns and its list ``chunks`` of (place in the recipe, digest, ...) in any order; null for a
    chunk that is not there."""
    placed = _placed(spark, folder).withColumn("needed", F.size("recipe"))
    links = placed.select("place", F.posexplode("recipe").alias("at", "digest"))
    lists = links.join(chunks, "digest", "left").groupBy("place").agg(F.collect_list(F.struct("at", "digest", *[c for c in chunks.columns if c != "digest"])).alias("chunks"))
    return placed.join(lists, "place", "left").select("doc_id", "start", "n_tokens", "root", "needed", "chunks")


def _verified_recipe(row: dict) -> list[dict]:
    chunks = sorted(row["chunks"] or [], key=lambda c: c["at"])
    if any(c["length"] is None for c in chunks) or len(chunks) != row["needed"] or sum(c["length"] for c in chunks) != row["n_tokens"] or merkle_root([c["digest"] for c in chunks]) != row["root"]:
        raise ValueError(f"document {row['doc_id']} cannot be put together again")
    return chunks


def read_checksums(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            crcs = []
            for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                raw = expand(packed)
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("length"), pa.array(crcs, pa.int64())], names=["digest", "length", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("chunks")
            flat, ends = lists.flatten(), (np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()).tolist()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            order = np.lexsort((flat.field("at").to_numpy(), row)).tolist()
            digest, length, crc = (flat.field(c).to_pylist() for c in ("digest", "length", "crc"))
            crcs, first = [], 0
            for end, needed, many, root, doc in zip(ends, *(batch.column(c).to_pylist() for c in ("needed", "n_tokens", "root", "doc_id")), strict=True):
                own, first = order[first:end], end
                if len(own) != needed or any(length[k] is None for k in own) or sum([length[k] for k in own]) != many or merkle_root([digest[k] for k in own]) != root:
                    raise ValueError(f"document {doc} cannot be put together again")
                joined = 0
                for k in own:
                    joined = crc_joined(joined, crc[k], 4 * length[k]) if joined else crc[k]
                crcs.append(joined)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    checked = _chunks(spark, folder).mapInArrow(check, "digest binary, length int, crc long")
    return _with_chunks(spark, folder, checked).mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, token_ids) of every document, put together from the chunks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            streams = [np.frombuffer(b"".join([expand(c["ids"]) for c in _verified_recipe(row)]), f"<u{width}").astype(np.int32) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(streams, pa.list_(pa.int32()))], names=["doc_id", "start", "token_ids"])

    return _with_chunks(spark, folder, _chunks(spark, folder)).mapInArrow(join, "doc_id long, start long, token_ids array<int>")
