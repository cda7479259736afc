"""From raw documents to packed sequences: filter, tell languages, drop copies and leaks, pack.

Each stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, language_id, near_dedup, packing, repetition
from textloom.llm.common import shared_dir, table
from textloom.session import ship


#: Bytes of a batch of texts that a worker gets at a time; stages share workers, whose memory adds up.
BATCH_BYTES = 8 << 20


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    _ready(spark)
    return repetition.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language."""
    _ready(spark)
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, by fingerprint or by 0.8 of their 5-word shingles, the one with the smallest id."""
    _ready(spark)
    return near_dedup.keep_one(docs, near=0.8, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item."""
    _ready(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    _ready(spark)
    return packing.pack(docs, cache=150_000, slice_bytes=1 << 20)  # its workers hold memory of the stages before


STAGES = [
    ("quality_rules", quality_rules),
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: SQL has neither the language model, the fingerprints nor the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every result is written and read again.

    Null and empty texts go in the first stage, as texts of too few words; long texts are
    read whole by every stage, and their pieces packed. Of equal rows the near-duplicate stage
    keeps those that share the smallest id. Extra columns stay until the last stage, whatever their names.
    No documents give no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
