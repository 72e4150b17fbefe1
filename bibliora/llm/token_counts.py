"""Token counts of text columns: a batch goes to the tokenizer's library in pieces, and only lengths come back.

Texts are taken in batches of about equal bytes. Within a batch they are cut at safe boundaries, places where the
tokens of the whole are always the tokens of the parts; each different piece is encoded once, and a text's count is
the sum over its pieces. Lengths of short pieces are remembered while a table bounded by bytes lasts.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; special strings
in a text are handled as the library does by default; repeated rows give repeated results; only the named columns are
read, so extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices, text_bytes

#: Bytes of text that are counted together; a longer text is counted by itself, in calls of as many bytes of pieces.
BATCH_BYTES = 8 << 20
#: Lengths are remembered for pieces of up to so many bytes, and forgotten when these take so many bytes together.
KEPT_PIECE, KEPT_BYTES, ENTRY_BYTES = 64, 160 << 20, 100

#: Kinds of bytes: parts of other characters, ASCII letters, digits, marks, apostrophe, white space, marks of special tokens.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, JOINER, KINDS = *range(7), 8
#: The settings under which the boundaries below are known to part tokens, as the tokenizer files state them.
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def boundary_rule(settings: dict[str, Any]) -> str:
    """How a tokenizer file lets texts be cut: "words" if white space goes and letters lose their case, "bytes" if white space
    belongs to what follows, "none" if the settings are not known to allow any cut."""
    added = settings.get("added_tokens") or []
    if any(set(" \t\n\v\f\r'0123456789") & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        return "none"
    steps, normalizer = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space") and normalizer is None:
        return "bytes"
    parts = steps.get("pretokenizers") or [{}]
    dropped = parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0].get("pattern") == {"Regex": WORD_SPLIT}
    plain = [p["type"] for p in parts[1:]] == ["ByteLevel"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    return "words" if dropped and plain and (normalizer or {}).get("normalizers") == WORD_NORMALIZER else "none"


class Cutter:
    """Cuts texts into pieces whose tokens, one after another, are the tokens of the text.

    Rules "words" and "bytes": between ASCII characters, a letter, a digit and a mark part from each other, because no
    pattern of such a file holds two of them, but for an apostrophe before a letter and for the characters of special tokens.
    "words" also parts digits, drops white space, and lowers A-Z where no accent follows. "bytes" cuts before white space
    that follows a character which surely is none. "one space" cuts at a single space between two printed ASCII
    characters and drops it. "none" leaves texts whole.
    """

    def __init__(self, rule: str, special: list[str] = ()) -> None:
        self.rule, self.special = rule, [t.encode() for t in special]
        self.kind = np.zeros(256, np.uint8)
        self.kind[33:127] = MARK
        self.kind[[*range(65, 91), *range(97, 123)]] = LETTER
        self.kind[48:58] = DIGIT
        self.kind[[0x20, *range(0x09, 0x0E)]] = SPACE
        self.kind[ord("'")] = APOSTROPHE
        self.kind[[b for t in self.special for b in t if not chr(b).isalpha()]] = JOINER
        self.cuts = np.zeros((KINDS, KINDS), bool)
        if rule in ("words", "bytes"):
            for a in (LETTER, DIGIT, MARK):
                for b in (LETTER, DIGIT, MARK):
                    self.cuts[a, b] = a != b
            self.cuts[[LETTER, DIGIT], APOSTROPHE] = self.cuts[APOSTROPHE, DIGIT] = True
            self.cuts[[LETTER, DIGIT, MARK, APOSTROPHE, JOINER], SPACE] = rule == "bytes"
        if rule == "words":
            self.cuts[DIGIT, DIGIT] = self.cuts[SPACE] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces, and how many come before each text (with all at the end)."""
        kind = self.kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.cuts.ravel()[kind[:-1] * np.uint8(KINDS) + kind[1:]]
        keep = None
        if self.rule == "bytes":  # two bytes, and no control sign or space
            cut[2:-1] |= (kind[2:] == SPACE) & (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
        elif self.rule == "words":
            keep, lower = kind != SPACE, self._lowered(data)
            data = lower
        elif self.rule == "one space":
            black = (kind > OTHER) & (kind != SPACE)
            start = np.zeros(len(data) + 1, bool)
            start[offsets] = True
            keep = np.ones(len(data), bool)
            keep[1:-1] = ~(black[:-2] & (data[1:-1] == 0x20) & black[2:] & ~start[1:-2] & ~start[2:-1])
            cut[1:] = ~keep
        cut[offsets] = True
        if keep is not None:
            cut, data, offsets = np.append(cut[:-1][keep], True), data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
            cut[offsets] = True
        bounds = np.flatnonzero(cut)
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, buffers), np.searchsorted(bounds, offsets)

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """A-Z lowered unless an accent may follow, or a special token would come up."""
        large = (data - np.uint8(65)) < 26
        large[:-1] &= data[1:] < 0x80
        lower = data + large.astype(np.uint8) * np.uint8(32)
        before, after = data.tobytes(), lower.tobytes()
        return lower if all(before.count(t) == after.count(t) for t in self.special) else data


class LengthEncoder:
    """Counts tokens as the library of a tokenizer file does: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, path: str) -> None:
        self.known: dict[str, int] = {}
        self.kept = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            names = [model.id_to_piece(n) for n in range(model.get_piece_size())]
            # without a token that goes on over a space, and with a space put before every text, a space parts tokens
            parted = not any("▁" in n.lstrip("▁") for n in names) and model.encode("a", out_type=str) == ["▁a"] and model.encode("a  b", out_type=str) == ["▁a", "▁", "▁b"]
            self.cutter = Cutter("one space" if parted else "none")
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                settings = json.load(file)
            self.cutter = Cutter(boundary_rule(settings), [t["content"] for t in settings.get("added_tokens") or []])
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _count(self, texts: list[str]) -> list[int]:
        """Lengths of different texts, in calls of about BATCH_BYTES."""
        found, start, size = [], 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_BYTES or at == len(texts) - 1:
                found += self.lengths(texts[start : at + 1])
                start, size = at + 1, 0
        return found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        parts, first = self.cutter(data, offsets)
        coded = parts.dictionary_encode()
        different, known = coded.dictionary.to_pylist(), self.known
        found = [known.get(piece, -1) for piece in different]
        new = [k for k, n in enumerate(found) if n < 0]
        for k, n in zip(new, self._count([different[k] for k in new]), strict=True):
            found[k] = n
            if len(different[k]) <= KEPT_PIECE:
                known[different[k]] = n
                self.kept += len(different[k]) + ENTRY_BYTES
        if self.kept > KEPT_BYTES:
            self.known, self.kept = {}, 0
        each = np.array(found, np.int64)[coded.indices.to_numpy()] if len(parts) else np.empty(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[first[1:]] - sums[first[:-1]]


@lru_cache(maxsize=2)
def length_encoder(path: str) -> LengthEncoder:
    """The encoder of a file, made once in each Python worker."""
    return LengthEncoder(path)


def count_tokens(documents: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; over_limit: more than ``limit`` tokens. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                data, offsets = text_bytes(part.column(text))
                counts = length_encoder(path).counts(data, offsets)
                columns = [part.column(key), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
