"""Where results go."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files whose names and lines are in the report's order."""
    (lines.orderBy("section", "ord", "name", "sub")
     .select(F.col("line").alias("value")).write.mode("overwrite").text(path))


def write_json(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def append_scan(results: DataFrame, path: str, scan_id: str, started_at: str) -> None:
    """Add a scan's rows to a history table, stamped with the scan.

    A repeated call replaces the rows of its own scan.  The scans themselves
    are listed in a table of their own, so that the last one is found without
    reading any result.
    """
    spark = results.sparkSession
    started = F.lit(started_at).cast("timestamp")
    (results.withColumn("scan_id", F.lit(scan_id)).withColumn("started_at", started)
     .write.mode("overwrite").parquet(_folder(path, scan_id)))
    (spark.range(1).select(started.alias("started_at"), F.lit(scan_id).alias("scan_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{path}/scans"))


def _folder(path: str, scan_id: str) -> str:
    return f"{path}/results/{quote(scan_id, safe='')}"


def _scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("started_at timestamp, scan_id string").parquet(f"{path}/scans")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last scan in a history; none, and only the stamps, after it was cleared."""
    last = _scans(spark, path).agg(F.max_by("scan_id", F.struct("started_at", "scan_id"))).first()[0]
    if last is None:
        return _scans(spark, path)
    return spark.read.parquet(_folder(path, last))


def clear_history(spark: SparkSession, path: str) -> None:
    """Empty a history: no scan is listed any more and every result folder holds no rows."""
    for row in _scans(spark, path).select("scan_id").toLocalIterator():
        folder = _folder(path, row["scan_id"])
        spark.createDataFrame([], spark.read.parquet(folder).schema).write.mode("overwrite").parquet(folder)
    spark.createDataFrame([], "started_at timestamp, scan_id string").write.mode("overwrite").partitionBy("scan_id").parquet(
        f"{path}/scans")


def write_files(files: DataFrame, path: str) -> None:
    """Rewritten files as a table that the next pass can read."""
    files.write.mode("overwrite").parquet(path)
