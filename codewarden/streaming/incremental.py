"""The same scan over files as they arrive.

Rules and signals look at one file at a time, so they run on a stream as they
are and keep no state.  Each batch is appended under its number; a batch that
is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from codewarden.config import ScanConfig
from codewarden.operators.scan import catalog, scan_rules


def findings_stream(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Rule findings of a streaming files table."""
    return scan_rules(files, catalog(config.active_policies))


def append_findings(files: DataFrame, folder: str, checkpoint: str,
                    config: ScanConfig = ScanConfig()) -> DataStreamWriter:
    """A writer that stores the findings of every batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (findings_stream(files, config).writeStream
            .foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append"))
