"""BPE encoding and decoding of text columns with the automaton of ``bpe_automaton``.

Defined results: a null or empty text has no tokens and decodes to the empty text; texts of any length are encoded
whole; rows are independent, so repeated rows give repeated results; only the named columns are read, so extra
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_automaton import WordTokenizer
from .words import slices

SLICE_BYTES = 3 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, compiled once in each Python worker."""
    return WordTokenizer(path)


def encode_text(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids array<int>, decoded string) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = tokenizer(path).encode_texts([t or "" for t in part.column(text).to_pylist()])
                ids = [[int(n) for n in numbers.split(" ")] if numbers else [] for numbers, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in found])], names=[key, "token_ids", "decoded"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, token_ids array<int>, decoded string")


def encode_digests(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_text``, but only (key, n_tokens, ids_sha256, decoded_sha256), so that no ids leave the task.

    The digests are SHA-256 in lower-case hex: of the decimal ids joined by one space, and of the decoded UTF-8.
    """

    def digest(content: str) -> str:
        return hashlib.sha256(content.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = tokenizer(path).encode_texts([t or "" for t in part.column(text).to_pylist()])
                counts = [numbers.count(" ") + 1 if numbers else 0 for numbers, _ in found]
                columns = [part.column(key), pa.array(counts, pa.int64()), pa.array([digest(n) for n, _ in found]), pa.array([digest(d) for _, d in found])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
