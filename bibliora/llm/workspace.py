"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (as in tests) that names none gets a temporary folder of its own; a cluster
    session without the setting is refused, because a machine-local folder would be invisible to the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="bibliora-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Collected:
    """Results that come block by block, written to one table, so that the plan that reads them does not grow."""

    def __init__(self, spark: SparkSession, schema: str, name: str) -> None:
        self.spark, self.schema, self.path = spark, schema, fresh_path(spark, name)
        self.add(spark.createDataFrame([], schema))

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` has written for these tables; plans that still read them must have run."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, folder)
