"""A table kept up to date by key, batch by batch.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets that it has keys of, into a folder of its own, and
then commits: a manifest that names the folder of every bucket, the schema and the last batch of every writer appears
under the next number, whole or not at all. What a batch wrote before it failed is named nowhere, so nobody reads it; a
batch that comes again is known by its number. Readers see one manifest, and so all of a batch or nothing of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


class Folder:
    """A folder of any file system that Spark reads, for small files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self._at("").getFileSystem(self.configuration)
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self.system.exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._at(name)))

    def text(self, name: str) -> str:
        stream = self.system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Make a file appear with all of its text; refuse if there is one of the name."""
        hidden = f"_{uuid.uuid4().hex}"
        stream = self.system.create(self._at(hidden), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.configuration)
        try:
            context.rename(self._at(hidden), self._at(name), self.none)
        except Exception as error:
            self.system.delete(self._at(hidden), False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(name) from None
            raise

    def remove(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def size(self, name: str) -> int:
        return int(self.system.getContentSummary(self._at(name)).getLength()) if self.system.exists(self._at(name)) else 0


class KeyedStore:
    """A table with one row for each value of ``keys``, in ``buckets`` buckets.

    ``order`` names columns by which the greatest row of a key stays, stored or new; without them a new row replaces the
    stored one, or with ``keep="first"`` never does. Of rows of one key in a batch the greatest by ``order`` and then by
    all columns counts, so that a batch done again gives the same. Null keys are a key like others. A bucket is written by
    one task: choose as many that a bucket of the final table fits one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, order: list[str] = (), keep: str = "last") -> None:
        self.spark, self.path, self.keys, self.buckets, self.order, self.keep = spark, path.rstrip("/"), list(keys), buckets, list(order), keep
        self.commits = Folder(spark, f"{self.path}/commits")

    def manifest(self) -> dict:
        """The newest manifest; of a store without one, an empty one."""
        numbers = [n for n in self.commits.names() if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "buckets": self.buckets, "keys": self.keys, "folders": {}, "writers": {}, "schema": None}
        found = json.loads(self.commits.text(numbers[-1]))
        if found["keys"] != self.keys or found["buckets"] != self.buckets:
            raise ValueError(f"the store has keys {found['keys']} in {found['buckets']} buckets")
        return found

    def read(self) -> DataFrame:
        """All rows of the newest manifest; an empty store has no schema and cannot be read."""
        now = self.manifest()
        if now["schema"] is None:
            raise ValueError(f"no batch has been committed to {self.path}")
        return self._rows(now, list(now["folders"].values()))

    def _rows(self, now: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def next_batch(self, writer: str = "") -> int:
        """The number of the first batch that a writer has not committed: where a stopped run goes on."""
        return self.manifest()["writers"].get(writer, -1) + 1

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the store does not have."""
        if self.manifest()["schema"] is None:
            return rows
        stored = self.read().select(*[F.col(k).alias(f"_stored_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in self.keys]
        return rows.join(stored, same, "left_anti")

    def upsert(self, batch: DataFrame, number: int, writer: str = "") -> bool:
        """Merge a batch; False if the writer has committed it, or a later one, before. Writers may work at the same time."""
        while True:
            now = self.manifest()
            if number <= now["writers"].get(writer, -1):
                return False
            try:
                self._merge(batch, number, writer, now)
            except Conflict:
                continue
            return True

    def _merge(self, batch: DataFrame, number: int, writer: str, now: dict) -> None:
        if now["schema"] is not None:
            stored = StructType.fromJson(now["schema"])
            if [(f.name, f.dataType) for f in stored] != [(f.name, f.dataType) for f in batch.schema]:
                raise ValueError(f"the store has the columns {stored.simpleString()}")
        columns, place = batch.columns, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(place.alias("b")).distinct().collect()]  # at most one for each bucket
        folder = f"data/{number:012d}-{uuid.uuid4().hex[:12]}"
        folders = dict(now["folders"])
        if touched:
            known = [folders[str(b)] for b in touched if str(b) in folders]
            rows = batch.withColumn("_new", F.lit(self.keep == "last"))
            if known:
                rows = rows.unionByName(self._rows(now, known).withColumn("_new", F.lit(self.keep != "last")))
            rank = F.struct(*[F.col(c) for c in self.order], "_new", *[F.xxhash64(F.to_json(F.struct(*columns))).alias("_text")])
            best = rows.groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(self.keys)]).agg(F.max_by(F.struct(*columns), rank).alias("_row")).select("_row.*")
            best.withColumn("_bucket", place).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            folders |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._before_commit(folder)
        schema = json.loads(batch.schema.json()) if now["schema"] is None else now["schema"]
        after = now | {"number": now["number"] + 1, "folders": folders, "writers": now["writers"] | {writer: number}, "schema": schema}
        self.commits.put(f"{after['number']:012d}.json", json.dumps(after))

    def _before_commit(self, folder: str) -> None:
        """What happens between writing and committing: nothing; tests fail here."""

    def sink(self, writer: str = "") -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function; the stream's batch numbers make it exactly once."""

        def write(batch: DataFrame, number: int) -> None:
            batch.persist()
            try:
                self.upsert(batch, number, writer)
            finally:
                batch.unpersist()

        return write

    def vacuum(self, manifests: int = 2) -> int:
        """Delete folders of batches that the newest manifests do not name, and older manifests; how many folders went.

        No batch may be on its way, as its folder is not named yet.
        """
        numbers = [n for n in self.commits.names() if n.endswith(".json")]
        kept = [json.loads(self.commits.text(n)) for n in numbers[-manifests:]]
        named = {f.split("/")[1] for m in kept for f in m["folders"].values()}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [f for f in data.names() if f not in named]
        for name in gone:
            data.remove(name)
        for name in numbers[:-manifests]:
            self.commits.remove(name)
        return len(gone)
