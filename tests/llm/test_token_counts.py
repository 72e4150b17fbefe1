import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bibliora.llm import queries, token_counts, tokenization
from bibliora.llm.words import text_bytes

ODD = [
    "don't <|endoftext|>x<|startoftext|> I'LL ΣΑΣ é éx", "a\x0bb\x0cc\x1cd\x85e f　g​h", " a", "a  b", "", "  ", "İstanbul ǅ ﬃ 漢字 😀", "x" * 70_000,
    "ab12" * 9000, "a  \nb ́x ý z", "▁ ▁a b▁ c", "<|ENDOFTEXT|> J̌ J̌x", "≠ '̸s don''s 'S.'s", "1a 1'a a'1 'll12", "a<b|c>d <| |>",
]


def expected(name, texts):
    path = tokenization.tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    library = Tokenizer.from_file(path)
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(name, corpus):
    rng = random.Random(5)
    letters = "ab1 \n\t é.,'　́Σ<|▁漢Z>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(3000)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x4E00, 0x9000), 32))) for _ in range(80)) for _ in range(500)]
    texts += [row[1] or "" for row in corpus]
    encoder = token_counts.LengthEncoder(tokenization.tokenizer_path(name))
    assert encoder.cutter.rule != "none"
    found = encoder.counts(*text_bytes(pa.array(texts)))
    wrong = [(t, n) for t, n, e in zip(texts, found.tolist(), expected(name, texts), strict=True) if n != e]
    assert not wrong
    assert encoder.counts(*text_bytes(pa.array(texts))).tolist() == found.tolist()  # from the remembered lengths


def test_settings_that_are_not_known_leave_texts_whole():
    token = {"content": "<x>", "lstrip": False, "rstrip": False, "single_word": False, "normalized": False}
    assert token_counts.boundary_rule({"pre_tokenizer": {"type": "Whitespace"}}) == "none"
    assert token_counts.boundary_rule({"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "added_tokens": [token | {"lstrip": True}]}) == "none"
    parts, first = token_counts.Cutter("none")(*text_bytes(pa.array(["a b", "", None, "c 1"])))
    assert parts.to_pylist() == ["a b", "c 1"] and first.tolist() == [0, 1, 1, 1, 2]


def test_pieces_of_words():
    parts, first = token_counts.Cutter("words", ["<|end|>"])(*text_bytes(pa.array(["Ab1,22 don't É", "", "x<|end|>y", "Z"])))
    assert parts.to_pylist() == ["ab", "1", ",", "2", "2", "don", "'t", "É", "x<|end|>y", "z"]
    assert np.diff(first).tolist() == [8, 0, 1, 1]


def test_the_remembered_lengths_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 2000)
    encoder = token_counts.LengthEncoder(tokenization.tokenizer_path())
    for k in range(40):
        encoder.counts(*text_bytes(pa.array([f"word{chr(97 + k % 26)}{chr(97 + k // 26)} " + "y" * 500_000])))
        assert encoder.kept <= 2000 and all(len(piece) <= token_counts.KEPT_PIECE for piece in encoder.known)


def test_columns(spark, documents, corpus, nothing):
    rows = token_counts.count_tokens(documents, tokenization.tokenizer_path(), limit=100).collect()
    texts = [row[1] or "" for row in corpus]
    counts = expected("word_bpe_49k.json", texts)
    assert sorted(map(tuple, rows)) == sorted((row[0], len(t.encode()), n, n > 100) for row, t, n in zip(corpus, texts, counts, strict=True))
    assert token_counts.count_tokens(nothing, tokenization.tokenizer_path()).isEmpty()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counts = dict(zip(texts, expected("word_bpe_49k.json", list(texts.values())), strict=True))
    rows = queries.op11_token_counts(spark, folder).collect()
    assert {tuple(r) for r in rows} == {(d, len(t.encode()), counts[d], counts[d] > 2048) for d, t in texts.items()}
    assert len(rows) == len(texts)
