"""The training-data pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm import decontaminate, ngram_join, packing, pii, toxicity
from codewarden.llm.common import fold, stored, table

#: Texts that a task gets at once; ten thousand, as Spark hands over, are tens of megabytes for each task, in the JVM and in Python.
PORTION = 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_portions(stage: Stage) -> Stage:
    """The stage in a session that hands `PORTION` rows to a task at once, also when its result is written later."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        if not 0 < now <= PORTION:
            spark.conf.set(name, PORTION)
        return stage(spark, docs, sf_dir)

    return run


@in_portions
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon rejects; it learns from the same rows as op8."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.clean(docs, model)


@in_portions
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram join, on five words and 0.8."""
    return ngram_join.dedupe(docs, width=5, least=(4, 5))


@in_portions
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_portions
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@in_portions
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_benchmark),
          ("personal_data", hide_personal_data), ("packing", pack)]

#: SQL cannot express a learned lexicon, alignments or a tokenizer; tests hold the operators, and the near copies, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
