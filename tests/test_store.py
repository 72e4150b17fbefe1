import random

import pytest
from pyspark.sql import functions as F

from bibliora.streaming.store import Conflict, Folder, KeyedStore

SCHEMA = "k long, v string, n int"


def table(store):
    return {r.k: (r.v, r.n) for r in store.read().collect()}


def test_batches_in_any_history_equal_a_dictionary(spark, tmp_path):
    rng, expected = random.Random(4), {}
    store = KeyedStore(spark, str(tmp_path), ["k"], buckets=5, order=["n"])
    for number in range(5):
        rows = [(rng.choice([*range(30), None]), f"b{number}", rng.randrange(6)) for _ in range(rng.randrange(0, 25))]
        assert store.upsert(spark.createDataFrame(rows, SCHEMA), number)
        assert not store.upsert(spark.createDataFrame([(1, "again", 99)], SCHEMA), number)
        for k, v, n in rows:
            if k not in expected or n >= expected[k][1]:
                expected[k] = (v, n)
        assert table(store) == expected
    assert store.next_batch() == 5
    todo = spark.createDataFrame([(k,) for k in [*range(60), None]], "k long")
    assert {r.k for r in store.missing(todo).collect()} == {*range(60), None} - set(expected)
    store.vacuum()
    assert table(store) == expected


def test_first_or_last_row_stays(spark, tmp_path):
    for keep, value in (("first", "a"), ("last", "b")):
        store = KeyedStore(spark, str(tmp_path / keep), ["k"], buckets=3, keep=keep)
        store.upsert(spark.createDataFrame([(1, "a", 5)], SCHEMA), 0)
        store.upsert(spark.createDataFrame([(1, "b", 1), (2, "c", 1)], SCHEMA), 1)
        assert table(store)[1][0] == value and len(table(store)) == 2


class Killed(KeyedStore):
    def _before_commit(self, folder):
        raise KeyboardInterrupt


def test_a_batch_killed_before_its_commit_is_done_again(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["k"], buckets=4)
    store.upsert(spark.createDataFrame([(k, "old", 0) for k in range(20)], SCHEMA), 0)
    batch = spark.createDataFrame([(k, "new", 1) for k in range(0, 40, 2)], SCHEMA)
    with pytest.raises(KeyboardInterrupt):
        Killed(spark, str(tmp_path), ["k"], buckets=4).upsert(batch, 1)
    assert set(table(store).values()) == {("old", 0)} and store.next_batch() == 1
    assert len(list((tmp_path / "data").iterdir())) == 2
    assert store.upsert(batch, 1)
    assert table(store) == {k: ("new", 1) if k % 2 == 0 else ("old", 0) for k in [*range(20), *range(20, 40, 2)]}
    assert store.vacuum(manifests=1) >= 1 and len(table(store)) == 30


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    other = KeyedStore(spark, str(tmp_path), ["k"], buckets=2)
    calls = []

    class Slow(KeyedStore):
        def _before_commit(self, folder):
            if not calls:
                calls.append(other.upsert(spark.createDataFrame([(1, "other", 0)], SCHEMA), 0, "other"))

    store = Slow(spark, str(tmp_path), ["k"], buckets=2)
    assert store.upsert(spark.createDataFrame([(1, "mine", 0), (2, "mine", 0)], SCHEMA), 0, "mine") and calls == [True]
    assert table(store) == {1: ("mine", 0), 2: ("mine", 0)}
    assert store.manifest()["writers"] == {"mine": 0, "other": 0}
    with pytest.raises(Conflict):
        store.commits.put("000000000001.json", "{}")


def test_what_is_rewritten_grows_with_the_batch(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["k"], buckets=32)
    big = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("n"))
    store.upsert(big, 0)
    store.upsert(spark.createDataFrame([(7, "x", 1)], SCHEMA), 1)
    data = Folder(spark, f"{tmp_path}/data")
    first, second = (data.size(n) for n in data.names())
    assert second < first / 20 and store.read().count() == 200_000


def test_other_columns_or_keys_are_refused(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["k"], buckets=2)
    with pytest.raises(ValueError, match="no batch"):
        store.read()
    store.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    with pytest.raises(ValueError, match="columns"):
        store.upsert(spark.createDataFrame([(1, "a")], "k long, v string"), 1)
    with pytest.raises(ValueError, match="buckets"):
        KeyedStore(spark, str(tmp_path), ["k"], buckets=3).manifest()
    assert store.upsert(spark.createDataFrame([], SCHEMA), 1) and table(store) == {1: ("a", 1)}


def test_stream_into_the_store(spark, tmp_path):
    source = tmp_path / "in"
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, f"{len(ids)}", 0) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        store = KeyedStore(spark, str(tmp_path / "store"), ["k"], buckets=2, keep="first")
        stream = spark.readStream.schema(SCHEMA).parquet(str(source)).writeStream.foreachBatch(store.sink("s"))
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert table(store) == {1: ("3", 0), 2: ("3", 0), 3: ("2", 0)}
