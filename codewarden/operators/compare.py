"""What changed between two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.functions.dialect import SPACE_CLASS
from codewarden.functions.text import trim_all


def fingerprints(findings: DataFrame) -> DataFrame:
    """Findings with ``fingerprint`` and ``ordinal``, which stay when lines above a finding come or go.

    A finding is known by its file, its rule and its line without extra white
    space; equal ones in a file are numbered from 1 in the order of the text.
    """
    line = F.regexp_replace(trim_all(F.coalesce("snippet", F.lit(""))), f"[{SPACE_CLASS}]+", " ")
    same = Window.partitionBy("file_path", "category", "rule_id", "_line").orderBy("start_line", "match_ord")
    numbered = findings.withColumn("_line", line).withColumn("ordinal", F.row_number().over(same))
    key = F.to_json(F.array("file_path", "category", "rule_id", "_line", F.col("ordinal").cast("string")))
    return numbered.withColumn("fingerprint", F.sha2(key, 256)).drop("_line")


def compare_scans(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per finding of either scan: ``status`` is new, gone or kept.

    Columns: fingerprint, status, file_path, category, rule_id, severity,
    ordinal, old_line, new_line.
    """
    slim = ["fingerprint", "file_path", "category", "rule_id", "severity", "ordinal"]
    old = fingerprints(before).select(*slim, F.col("start_line").alias("old_line"))
    new = fingerprints(after).select(*slim, F.col("start_line").alias("new_line"))
    status = F.when(F.col("b.fingerprint").isNull(), "new").when(F.col("a.fingerprint").isNull(), "gone").otherwise("kept")
    both = old.alias("b").join(new.alias("a"), F.col("b.fingerprint") == F.col("a.fingerprint"), "full")
    return both.select(
        F.coalesce("a.fingerprint", "b.fingerprint").alias("fingerprint"), status.alias("status"),
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in slim[1:]], "old_line", "new_line")
