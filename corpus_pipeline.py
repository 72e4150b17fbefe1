"""From raw documents to tokens: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibliora.llm import mixing, near_dedup, quality, substring_dedup, tokenization
from bibliora.llm.workspace import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that Spark hands to a Python worker at once: whole rows of documents go through, so that batches stay small. With
#: Spark's own bounds the first stage took more than an executor of 3000 MB has.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(stage: Stage) -> Stage:
    """The stage in a session that keeps Arrow batches to BATCH_ROWS rows, unless they are smaller already.

    Spark reads the setting when the stage's rows are written, so it has to outlast this call; ``run`` puts it back.
    """

    @wraps(stage)
    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return small


@_small_batches
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.without_low_quality(docs, quality.co_train(docs, labels))


@_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Five-word shingles, similarity 0.8.

    Of rows with one doc_id and one text the first stays, in the order of a hash of all columns. Rows with one doc_id and
    different texts are judged each by its own text.
    """
    groups = near_dedup.near_duplicate_groups(docs, n=5, percent=80)
    dropped = groups.filter("NOT kept").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = rows.join(dropped, (rows["doc_id"].cast("long") == F.col("__doc")) & (rows["__text_hash"] == F.col("__hash")), "left_anti")
    copies = Window.partitionBy("doc_id", "__text_hash").orderBy(F.xxhash64(*docs.columns))
    first = F.when(F.col("doc_id").isNotNull(), F.row_number().over(copies)).otherwise(1)
    return kept.withColumn("__place", first).filter("__place = 1").select(docs.columns)


@_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; n_chars follows; emptied documents go."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter("text IS NULL OR text <> ''")


@_small_batches
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; rows repeat."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text: the end of the pipeline."""
    return tokenization.encode_digests(docs, tokenization.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier, connected components or BPE; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, after all stages over ``documents``. The session's settings are left as they were."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return STAGES[-1][1](spark, docs, sf_dir)
