import random
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibliora.llm import token_store, tokenization, workspace
from bibliora.llm.bpe_automaton import Automaton

PATH = tokenization.tokenizer_path()
ODD = [
    "don't <|endoftext|>x<|startoftext|> I'LL ΣΑΣ é éx", "a\x0bb\x0cc\x1cd\x85e f　g​h", "İstanbul ǅ ﬃ 漢字 😀 १२ ̈́ Å",
    "aaaaaaa aaa aa a", "x" * 5000, "haha" * 60, "'S 'T don'Ts", "\x00\x01 ɏ", "word.,;word!!", "1234 ½ ²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice((rng.randrange(0, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x4E00, 0x9000)))) for _ in range(80)) for _ in range(150)]
    return ODD + noise + [r[1] or "" for r in corpus]


def test_automaton_and_decoding_equal_the_library(library, texts):
    found = tokenization.tokenizer(PATH).encode_texts(texts)
    for text, (ids, decoded) in zip(texts, found, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, expected))
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_a_word_of_a_million_letters_equals_the_library(library):
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    for text in (word, "ha" * 250_000, "é" * 100_000):
        ids, _ = tokenization.tokenizer(PATH).encode_texts([text])[0]
        assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_words_alone_and_together_have_one_path():
    automaton = tokenization.tokenizer(PATH).automaton
    rng = random.Random(9)
    words = [bytes(rng.choice(b"aehnt\xc3\xa9") for _ in range(length)) for length in (1, 2, 5, 9, 14, 40) for _ in range(40)]
    assert automaton.encode_many(words) == [automaton.encode_many([w])[0] for w in words]


def test_automaton_of_few_merges_equals_rewriting():
    merges = [(97, 97), (512, 97), (97, 98), (512, 514), (98, 98 + 256), (514, 516)]
    automaton = Automaton(merges)
    rng = random.Random(4)
    for _ in range(300):
        word = [rng.choice((97, 98)) for _ in range(rng.randrange(1, 9))]
        tokens = word[:-1] + [word[-1] + 256]
        for c, (a, b) in enumerate(merges, 512):
            k, out = 0, []
            while k < len(tokens):
                if tokens[k : k + 2] == [a, b]:
                    out.append(c)
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        assert automaton.encode_many([bytes(word)]) == [tokens]


def test_columns_and_digests(spark, documents, library, nothing):
    rows = tokenization.encode_text(documents, PATH).join(documents.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    assert tokenization.encode_digests(documents, PATH).filter("n_tokens = 0").count() == 3
    assert tokenization.encode_digests(nothing, PATH).isEmpty()


def test_store_round_trip(spark, documents, library):
    folder = workspace.fresh_path(spark, "store")
    token_store.write_store(documents, folder, PATH, end_id=1)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    expected = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    sums = token_store.read_checksums(spark, folder).orderBy("start").collect()
    at = 0
    for r in sums:
        ids = expected[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in sums] == sorted(r.doc_id for r in documents.collect())
    assert all(r.token_ids == expected[r.doc_id] for r in token_store.read_tokens(spark, folder).collect())
    chunks = spark.read.parquet(f"{folder}/new/is_recipe=false")
    assert chunks.count() == chunks.select("digest").distinct().count()


@pytest.fixture(scope="module")
def store(spark, documents):
    folder = workspace.fresh_path(spark, "store")
    token_store.write_store(documents.filter("doc_id < 60"), folder, PATH, end_id=1)
    return folder


def rewritten(spark, store, table, change):
    """A copy of the store in which ``change`` has been made to the rows of one table."""
    folder = workspace.fresh_path(spark, "damaged")
    shutil.copytree(store.removeprefix("file://"), folder.removeprefix("file://"))
    rows = spark.read.parquet(f"{store}/{table}")
    workspace.remove(spark, f"{folder}/{table}")
    change(rows).write.parquet(f"{folder}/{table}")
    return folder


@pytest.mark.parametrize(
    ("table", "change"),
    [
        ("new/is_recipe=false", lambda rows: rows.filter("xxhash64(digest) % 2 = 0")),
        ("new/is_recipe=false", lambda rows: rows.filter("false")),
        ("recipes/is_manifest=false", lambda rows: rows.filter("doc_id % 7 <> 3")),
        ("recipes/is_manifest=false", lambda rows: rows.filter("part <> 1")),
        ("recipes/is_manifest=false", lambda rows: rows.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == 5, 1).otherwise(0))),
        ("recipes/is_manifest=false", lambda rows: rows.withColumn("root", F.when(F.col("doc_id") == 5, F.lit(b"x")).otherwise(F.col("root")))),
        ("manifest", lambda rows: rows.filter("part <> 1")),
        ("manifest", lambda rows: rows.withColumn("file_root", F.lit(b"other"))),
    ],
)
def test_store_notices_damage(spark, store, table, change):
    folder = rewritten(spark, store, table, change)
    for read in (token_store.read_checksums, token_store.read_tokens):
        with pytest.raises(Exception, match="cannot be put together|lost or changed|is missing|the manifest of"):
            read(spark, folder).collect()


def test_merkle_root_of_digests_one_by_one():
    for many in range(20):
        digests, tree = [bytes([k]) for k in range(many)], token_store.MerkleTree()
        for digest in digests:
            tree.add(digest)
        assert tree.root() == token_store.merkle_root(digests)


def test_empty_store_and_chunking(spark, nothing):
    folder = workspace.fresh_path(spark, "store")
    token_store.write_store(nothing, folder, PATH, end_id=1)
    assert token_store.read_checksums(spark, folder).isEmpty()
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 30_000).astype("<u2")
    cuts = token_store.cut_points(ids)
    sizes = np.diff(cuts, prepend=0)
    assert cuts[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    shifted = token_store.cut_points(np.concatenate([ids[:7], ids]))
    assert len(set((shifted - 7).tolist()) & set(cuts.tolist())) > len(cuts) / 2
    assert token_store.crc_joined(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_caches_are_bounded_by_bytes(library, monkeypatch):
    from bibliora.llm import bpe_automaton

    monkeypatch.setattr(bpe_automaton, "CACHE_BYTES", 200_000)
    monkeypatch.setattr(token_store, "CACHE_BYTES", 200_000)
    tokenizer, encoder = bpe_automaton.WordTokenizer(PATH), token_store.IdEncoder(PATH, 2)
    rng = random.Random(3)
    for _ in range(12):
        word = "".join(rng.choice("abcdefghij") for _ in range(100_000))
        ids = library.encode(word, add_special_tokens=False).ids
        assert tokenizer.encode_texts([word, "and"])[0][0] == " ".join(map(str, ids))
        assert encoder.encode([word, "and"])[0].tolist() == ids
        assert len(tokenizer.known) < 8 and len(encoder.numbers) < 8 and encoder.pool.nbytes < 600_000
