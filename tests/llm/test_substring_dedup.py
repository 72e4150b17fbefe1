import hashlib

import numpy as np
import pyarrow as pa
import pytest

from bibliora.llm import substring_dedup
from bibliora.llm.fm_index import FMIndex, WaveletTree
from bibliora.llm.words import text_bytes, word_hashes, word_spans


def brute_force(rows, window=50):
    first, gone = {}, {}
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        cut = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                cut[k : k + window] = [True] * window
        kept = [x for x, c in zip(w, cut, strict=True) if not c]
        out.append((d, len(w), sum(cut), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_removals_equal_brute_force(documents, corpus, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    found = sorted(tuple(r) for r in substring_dedup.removal_digests(documents).collect())
    assert found == brute_force(corpus)
    assert sum(r[2] for r in found) > 1000


def rows_of_a_shard(rng, window=8):
    """Passages of a word stream with changes for each of 12 anchors, in order; and their intervals by brute force."""
    rows, base = [], [f"w{k}" for k in range(40)]
    for anchor in range(12):
        for doc in range(rng.integers(1, 9)):
            n = int(rng.integers(1, 20))
            words = [f"{w}a{anchor}" if rng.random() > 0.05 else f"x{rng.integers(9)}" for w in base[anchor : anchor + n + window - 1]]
            rows.append((anchor, 10 * doc + int(rng.integers(3)), hash(tuple(words)), 1000 * anchor + 100 * doc, n, " ".join(words).encode()))
    rows.sort()
    first, expected = {}, set()
    for _, doc, _, _, n, content in rows:
        for k in range(n):
            key = tuple(content.split()[k : k + window])
            first[key] = min(first.get(key, doc), doc)
    for _, doc, _, start, n, content in rows:
        expected |= {(doc, start + k) for k in range(n) if first[tuple(content.split()[k : k + window])] < doc}
    names = ["anchor", "doc_id", "passage", "start", "n", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    table = pa.table({name: pa.array(column, kind) for name, kind, column in zip(names, kinds, zip(*rows, strict=True), strict=True)})
    return table.append_column("version", table.column("doc_id")), expected


@pytest.mark.parametrize("most", [1, 60, 10_000])
def test_a_shard_finds_what_brute_force_finds(monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", most)
    for seed in range(10):
        table, expected = rows_of_a_shard(np.random.default_rng(seed))
        found = [r for part in substring_dedup._shard(iter(table.to_batches(max_chunksize=7)), 8) for r in part.to_pylist()]
        assert {(r["doc_id"], k) for r in found for k in range(r["a"], r["b"] - 7)} == expected


def test_without_the_index_nothing_is_found(monkeypatch):
    table, expected = rows_of_a_shard(np.random.default_rng(1))
    assert expected
    monkeypatch.setattr(FMIndex, "matching_statistics", lambda self, symbols, first, least: (np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)))
    assert sum(part.num_rows for part in substring_dedup._shard(iter(table.to_batches()), 8)) == 0


def test_texts_after_removal_keep_other_columns(documents, corpus):
    found = substring_dedup.without_repeats(documents)
    assert found.columns == documents.columns
    kept = {(r.doc_id, r._size, r.p, len((r.text or "").split())) for r in found.collect()}
    assert kept == {(d, "extra", 1, n - gone) for d, n, gone, _ in brute_force(corpus)}


def test_empty_table_and_null_ids(spark, nothing):
    assert substring_dedup.removal_digests(nothing).isEmpty()
    text = " ".join(map(str, range(60)))
    rows = substring_dedup.removal_digests(spark.createDataFrame([(None, text), (3, text), (5, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (3, 0), (5, 60)]


def test_different_texts_of_one_id_are_judged_each_by_itself(spark):
    text = " ".join(map(str, range(70)))
    rows = [(4, text), (7, text), (7, "short " + text[:20]), (7, "x " * 90 + text + " y"), (7, text), (2, "z " * 55)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substring_dedup.removal_digests(documents).collect()) == brute_force(rows)
    kept = sorted((r.doc_id, len(r.text.split())) for r in substring_dedup.without_repeats(documents).collect())
    assert kept == sorted((d, n - gone) for d, n, gone, _ in brute_force(rows))


def test_wavelet_tree_counts_and_is_small():
    rng = np.random.default_rng(2)
    values = np.minimum(rng.geometric(0.4, 5000), 40)
    wavelet = WaveletTree(values)
    places, symbols = np.arange(0, 5001, 7), rng.choice(values, 715)
    assert wavelet.rank(symbols, places).tolist() == [int((values[:p] == s).sum()) for p, s in zip(places, symbols, strict=True)]
    shares = np.bincount(values)[np.unique(values)] / len(values)
    assert 64 * len(wavelet.words) <= len(values) * (1 - (shares * np.log2(shares)).sum()) + 64


def test_matching_statistics_of_other_sequences():
    rng = np.random.default_rng(4)
    lengths, others = rng.integers(6, 30, 40), rng.integers(1, 40, 20)
    symbols, first = rng.integers(1, 5, lengths.sum()), np.append(0, np.cumsum(lengths))
    owners = rng.integers(0, 1000, 40)
    index = FMIndex(symbols, first, owners, 6)
    least = {}
    for s, owner in enumerate(owners.tolist()):
        sequence = tuple(symbols[first[s] : first[s + 1]])
        for k in range(len(sequence)):
            for to in range(k + 1, len(sequence) + 1):
                least[sequence[k:to]] = min(least.get(sequence[k:to], owner), owner)
    streamed, starts = rng.integers(0, 5, others.sum()), np.append(0, np.cumsum(others))
    length, row = index.matching_statistics(streamed, starts)
    found = index.least_owners(length, row, -1)
    for s in range(20):
        for k in range(starts[s], starts[s + 1]):
            sequence = tuple(streamed[k : starts[s + 1]])
            many = 0
            while many < len(sequence) and sequence[: many + 1] in least:
                many += 1
            assert length[k] == many
            assert found[k] == (least[sequence[:6]] if many >= 6 else -1)


def test_words_of_one_hash_under_powers_of_a_base_differ():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = pa.array([word, word.translate(str.maketrans("ab", "ba"))])
    data, offsets = text_bytes(texts)
    starts, ends, _ = word_spans(data, offsets)
    one, other = word_hashes(data, starts, ends)
    assert one != other
