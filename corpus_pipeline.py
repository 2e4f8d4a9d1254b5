"""A corpus pipeline of five stages over `documents`; run() gives the rows of the last.

All stages but the last return the columns of `documents`: texts of no known language go, one document of each group of near
copies stays, documents with benchmark passages go, personal data is masked, and the rest is dealt into batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrist.llm import decontaminate, langid, minhash, packing, pii
from terragrist.llm.shared import Scratch, boxed, small_batches, unboxed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known and at least 0.4 certain."""
    small_batches(spark)
    found = langid.identify(boxed(docs, "text"), langid.fit(docs))
    return unboxed(found.filter("lang_pred <> 'und' and score >= 0.4"), docs.columns, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return minhash.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that overlap no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = boxed(docs, of=F.xxhash64("text"))  # by text, as ids may be null or come with other texts
    gone = decontaminate.contaminated_ids(texts.select("of", F.col("doc.text").alias("text")), items, id_col="of")
    return unboxed(_without(texts, gone.withColumnRenamed("doc_id", "of"), "of"), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    small_batches(spark)
    masked = pii.redact(boxed(docs, "text", "n_chars"), pii.train(docs))
    return unboxed(masked.withColumn("n_chars", F.length("text").cast("long")), docs.columns, "text", "n_chars")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level lengths in optimal buckets and token-budget batches."""
    return packing.pack(packing.with_byte_tokens(docs), "doc_id", "n_tokens")


def _without(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows with other values in column `on`. Up to a million values go to every task, more are joined by a shuffle."""
    ids = Scratch(docs.sparkSession, "gone").table(ids, "ids")
    if ids.count() <= minhash.BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, on, "left_anti")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_batches),
]

#: A network, signatures and an estimated model have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
