"""Files as they are saved: each content once, findings per time window, and a gate against a baseline.

State is bounded by the watermark: a content is remembered, and a window kept open, until event time has passed it by
``delay``; what comes later is not counted.  Sinks keep a folder per batch, so a batch that is repeated after a failure
replaces what it wrote and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def first_saves(files: DataFrame, keys: Sequence[str] = ("file_path",), time: str = "ts", delay: str = "1 day") -> DataFrame:
    """One row per ``keys`` and content among those whose times lie within ``delay``, for streams and tables.

    ``digest`` is the hash of the text; a null text is a content of its own.
    """
    keyed = files.withColumn("digest", F.sha2(F.coalesce("code", F.lit("\0")), 256))
    if not files.isStreaming:
        return keyed.dropDuplicates([*keys, "digest"])
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "digest"])


def window_counts(findings: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 day",
                  by: Sequence[str] = ("severity",)) -> DataFrame:
    """Findings per window of event time: ``begin``, ``end``, the columns ``by``, ``findings``."""
    timed = findings.withWatermark(time, delay) if findings.isStreaming else findings
    return (timed.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("findings"))
            .select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "findings"))


def keep_updates(counts: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the rows that a batch changed."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def last_updates(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each key in a folder of ``keep_updates``."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
            .select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]))


def baseline(findings: DataFrame, periods: int, by: Sequence[str] = ("severity",)) -> DataFrame:
    """``expected``: findings per period, from a table of ``periods`` periods."""
    return findings.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(periods)).alias("expected"))


def gate(findings: DataFrame, period: Column, expected: DataFrame, tolerance: float = 0.5, allowance: float = 5,
         by: Sequence[str] = ("severity",)) -> DataFrame:
    """Each period's findings against the baseline.

    Columns: period, the columns ``by``, findings, expected, deviation
    (findings over expected; null without expectation), passed.  A period fails
    with more than ``expected * (1 + tolerance) + allowance``; a kind of finding
    that the baseline does not know is expected 0 times.
    """
    counted = findings.groupBy(period.alias("period"), *by).agg(F.count(F.lit(1)).alias("findings"))
    known = F.coalesce("expected", F.lit(0.0))
    return counted.join(expected, list(by), "left").select(
        "period", *by, "findings", known.alias("expected"), F.when(known > 0, F.col("findings") / known).alias("deviation"),
        (F.col("findings") <= known * (1 + tolerance) + allowance).alias("passed"))


def gated(findings: DataFrame, folder: str, checkpoint: str, check: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that checks every batch, as ``gate`` does, and keeps the verdicts under the batch's number."""
    def write(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def run_available(writer: DataStreamWriter) -> None:
    """Work off what is there now; an error of the stream is raised."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
