"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("code", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
])

INDICATOR = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])

FINDINGS = T.StructType([
    T.StructField("finding_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_rank", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("match_ord", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("policy_rule", T.StringType()),
    T.StructField("indicators", T.ArrayType(INDICATOR)),
    T.StructField("ai_reason", T.StringType()),
])
FINDING_COLUMNS = [f.name for f in FINDINGS.fields]
