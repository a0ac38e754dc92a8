"""Roll-ups over findings and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.catalog import ANALYZER_ORDER
from codewarden.config import ScanConfig
from codewarden.functions.paths import detect_language
from codewarden.functions.severity import risk_weight, severity_name
from codewarden.operators.authorship import score_band

SEVERITIES = ("critical", "high", "medium", "low")


def analyzer_ord(category: Column) -> Column:
    out = F.lit(len(ANALYZER_ORDER))
    for name, value in ANALYZER_ORDER.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def scan_order() -> list[Column]:
    """The order in which a scan reports findings."""
    return [F.col("file_path"), analyzer_ord(F.col("category")), F.col("rule_ord"), F.col("start_line"),
            F.col("match_ord")]


def union_findings(*streams: DataFrame) -> DataFrame:
    """All findings in one table."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row, without joining them."""
    names = [c for r in rows for c in r.columns]
    return union_findings(*rows).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES]


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total_findings"), *_severity_counts())


def severity_by_language(findings: DataFrame) -> DataFrame:
    """Severity counts of each language."""
    return (findings.groupBy(detect_language(F.col("file_path")).alias("language"))
            .agg(F.count(F.lit(1)).alias("total_findings"), *_severity_counts()))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings and files by language and severity, with the subtotal of each language and the total.

    ``level`` is 0 for a language and severity, 1 for a language, 3 for all.
    """
    return (findings.select(detect_language(F.col("file_path")).alias("language"), "severity", "file_path")
            .rollup("language", "severity")
            .agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("findings"),
                 F.countDistinct("file_path").alias("files")))


def file_counts(findings: DataFrame) -> DataFrame:
    """Counts and worst severity of each file that has a finding."""
    category = F.col("category")
    return findings.groupBy("file_path").agg(
        F.count_if(category == "vulnerability").alias("vulnerabilities"),
        F.count_if(category == "policy-violation").alias("policy_violations"),
        F.count(F.lit(1)).alias("findings"),
        F.max("severity_rank").alias("worst"),
    )


def file_results(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per scanned file, from slim rows keyed by path: no text is read."""
    zero = F.lit(0)
    return (scores.select("file_path", "ai_score", "lines_total").join(file_counts(findings), "file_path", "left")
            .select(
                "file_path", detect_language(F.col("file_path")).alias("language"),
                F.col("lines_total").alias("lines_of_code"), "ai_score",
                F.coalesce("vulnerabilities", zero).alias("vulnerabilities"),
                F.coalesce("policy_violations", zero).alias("policy_violations"),
                F.coalesce("findings", zero).alias("findings"),
                severity_name(F.col("worst")).alias("severity")))


def scan_summary(files: DataFrame, findings: DataFrame, scores: DataFrame,
                 config: ScanConfig = ScanConfig()) -> DataFrame:
    """The one-row summary of a scan.

    The three inputs are aggregated on their own and meet as single rows.  A
    file that has no score could not be read; no text is looked at for that.
    """
    counted = files.agg(F.count(F.lit(1)).alias("files"))
    scored = scores.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("ai_score") >= config.detection_threshold).alias("ai_generated_files"),
        F.coalesce(F.avg("ai_score"), F.lit(0.0)).alias("average_ai_score"))
    malicious = F.coalesce(F.bool_or(F.col("category") == "malicious"), F.lit(False))
    totals = findings.agg(F.count(F.lit(1)).alias("total_findings"), *_severity_counts(),
                          malicious.alias("has_malicious"))
    one = side_by_side(counted, totals, scored)
    return one.select("files_scanned", (F.col("files") - F.col("files_scanned")).alias("files_skipped"),
                      *[c for c in one.columns if c not in ("files", "files_scanned")])


def risk_scores(findings: DataFrame) -> DataFrame:
    """Vulnerability risk of each file, 0 to 10."""
    n = F.count(F.lit(1))
    critical = F.count_if(F.col("severity") == "critical")
    score = F.least(F.lit(10.0), F.sum(risk_weight(F.col("severity"))) / (n * 10) * 10 + critical * 2)
    return (findings.filter(F.col("category") == "vulnerability").groupBy("file_path")
            .agg(n.alias("vulnerabilities"), critical.alias("criticals"), score.alias("risk_score")))


def category_shares(findings: DataFrame) -> DataFrame:
    """Findings of each category, and their share of the largest one."""
    counts = findings.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))
    # One row per category: the window sees a handful of rows.
    return counts.withColumn("share", F.col("findings") / F.max("findings").over(Window.partitionBy()))


def severity_shares(counts: DataFrame) -> DataFrame:
    """The four severities of a one-row count, and their share of the largest."""
    top = F.greatest(*[F.col(f"{s}_count") for s in SEVERITIES], F.lit(1))
    entries = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("severity"), F.col(f"{s}_count").alias("findings"))
        for i, s in enumerate(SEVERITIES)])
    return (counts.select(top.alias("top"), F.explode(entries).alias("e"))
            .select("e.ord", "e.severity", "e.findings", (F.col("e.findings") / F.col("top")).alias("share")))


def top_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    """The k worst findings; equals keep the scan order."""
    return findings.orderBy(F.col("severity_rank").desc(), *scan_order()).limit(k)


def first_findings_per_file(findings: DataFrame, k: int = 5) -> DataFrame:
    """The first k findings of each file, numbered from 1.

    Spark drops rows beyond k before the shuffle, so a file that holds most of
    the findings does not arrive as one heavy group.
    """
    order = scan_order()[1:]
    w = Window.partitionBy("file_path").orderBy(*order)
    return findings.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def files_by_score(results: DataFrame, k: int | None = None) -> DataFrame:
    """Files by falling score, with the band a list shows."""
    out = results.withColumn("band", score_band(F.col("ai_score"))).orderBy(F.col("ai_score").desc(), "file_path")
    return out if k is None else out.limit(k)


def search_findings(findings: DataFrame, category: str = "all", severity: str = "all", text: str = "",
                    false_positives: DataFrame | None = None, show_false_positives: bool = False) -> DataFrame:
    """The findings a filter leaves.

    ``text`` is looked for, whatever its case, in title, description, path,
    recommendation and snippet.  Findings marked as false positives are hidden
    unless they are asked for.
    """
    out = findings
    if category != "all":
        out = out.filter(F.col("category") == category)
    if severity != "all":
        out = out.filter(F.col("severity") == severity)
    needle = text.lower().strip()
    if needle:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in
                                         ("title", "description", "file_path", "recommendation", "snippet")]))
        out = out.filter(F.contains(hay, F.lit(needle)))
    if false_positives is not None and not show_false_positives:
        out = out.join(false_positives.select("finding_id"), "finding_id", "left_anti")
    return out


def visible_counts(findings: DataFrame, shown: DataFrame, false_positives: DataFrame) -> DataFrame:
    """How many findings a list shows, could show, and hides."""
    n = F.count(F.lit(1))
    counts = side_by_side(shown.agg(n.alias("filtered")), findings.agg(n.alias("total")),
                          false_positives.select("finding_id").distinct().agg(n.alias("hidden")))
    return counts.select("filtered", (F.col("total") - F.col("hidden")).alias("visible_total"), "hidden")


def latest_scan(history: DataFrame) -> DataFrame:
    """The rows of the scan that started last, from scan-stamped results."""
    last = history.agg(F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("scan_id"))
    return history.join(F.broadcast(last), "scan_id", "left_semi")
