"""Whole scans.

A scan makes two passes over the text: one for all pattern and policy rules,
one for the authorship signals.  What leaves the passes is slim; every roll-up
works on those tables.  ``keep`` (in the shared folder) and ``store`` (in a folder
of the caller) write them once, so that the roll-ups do not repeat the passes, read
only the columns they need and survive a lost executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from codewarden.config import ScanConfig
from codewarden.functions.lineage import cut_lineage
from codewarden.operators.authorship import authorship, authorship_findings
from codewarden.operators.context import add_context
from codewarden.operators.policy import compliance, policy_scores, policy_status
from codewarden.operators.report import recommendations, report_json, report_lines, with_times
from codewarden.operators.rollup import file_results, scan_summary, top_findings, union_findings
from codewarden.operators.scan import catalog, scan_rules
from codewarden.sources.files import discover


@dataclass(frozen=True)
class Scan:
    """The tables of one scan."""

    files: DataFrame
    findings: DataFrame
    scores: DataFrame
    config: ScanConfig

    def file_results(self) -> DataFrame:
        return file_results(self.findings, self.scores)

    def summary(self) -> DataFrame:
        return scan_summary(self.files, self.findings, self.scores, self.config)

    def top_findings(self, k: int = 10) -> DataFrame:
        return top_findings(self.findings, k)

    def policy_status(self) -> DataFrame:
        return policy_status(self.findings, self.config.active_policies)

    def policy_scores(self) -> DataFrame:
        return policy_scores(self.scores, self.findings, self.config.active_policies)

    def compliance(self) -> DataFrame:
        return compliance(self.policy_status())

    def recommendations(self) -> DataFrame:
        return recommendations(self.summary())

    def timed_summary(self, times: tuple[str, str] | None) -> DataFrame:
        """The summary, with the begin and end of the scan if they are given."""
        return self.summary() if times is None else with_times(self.summary(), *times)

    def report(self, project: str = "project", times: tuple[str, str] | None = None) -> DataFrame:
        return report_lines(self.timed_summary(times), self.findings, self.file_results(), project)

    def report_json(self, times: tuple[str, str] | None = None, pretty: bool = False) -> DataFrame:
        return report_json(self.timed_summary(times), pretty)


def scan_files(files: DataFrame, config: ScanConfig = ScanConfig(), replies: DataFrame | None = None,
               with_context: bool = False) -> Scan:
    """Scan the files as they are given.

    ``with_context`` gives each finding the lines of the function around it, cut
    out while its file is scanned: requests then need neither text nor join.
    """
    rules = catalog(config.active_policies)
    if not with_context:
        scores = authorship(files, config, replies)
        return Scan(files, union_findings(authorship_findings(scores), scan_rules(files, rules)), scores, config)
    scores = authorship(files, config, replies, keep=("code",))
    ai = add_context(authorship_findings(scores, ("code",)))
    return Scan(files, union_findings(ai, scan_rules(files, rules, context=True)), scores.drop("code"), config)


def scan_project(files: DataFrame, config: ScanConfig = ScanConfig(), replies: DataFrame | None = None) -> Scan:
    """Scan the files that a project scan would collect."""
    return scan_files(discover(files, config), config, replies)


def keep(scan: Scan) -> Scan:
    """Write scores and findings, scores first: the authorship findings are
    read from them, so each pass over the text runs once."""
    scores = cut_lineage(scan.scores)
    rules = scan_rules(scan.files, catalog(scan.config.active_policies))
    return Scan(scan.files, cut_lineage(union_findings(authorship_findings(scores), rules)), scores, scan.config)


def store(scan: Scan, folder: str) -> Scan:
    """Like ``keep``, as tables below ``folder``."""
    spark = scan.files.sparkSession
    scan.scores.write.mode("overwrite").parquet(f"{folder}/scores")
    scores = spark.read.parquet(f"{folder}/scores")
    rules = scan_rules(scan.files, catalog(scan.config.active_policies))
    union_findings(authorship_findings(scores), rules).write.mode("overwrite").parquet(f"{folder}/findings")
    return Scan(scan.files, spark.read.parquet(f"{folder}/findings"), scores, scan.config)
