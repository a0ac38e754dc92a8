"""Queries over the given tables, one per operator group."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.catalog import POLICY_RULES, VULNERABILITY_RULES, Rule
from codewarden.config import ScanConfig
from codewarden.functions.lineage import cut_lineage, shared_folder
from codewarden.operators import authorship as author
from codewarden.operators import compare, context, index, policy, remedy, replies, report, rollup, scan, shell
from codewarden.plans.project import Scan, keep, scan_files
from codewarden.sources import files as src
from codewarden.sources import sinks, tree
from codewarden.streaming import events
from workloads import corpus
from workloads.snippets import FIX_REPLIES

Query = Callable[[SparkSession, str], DataFrame]

PROJECT = "project"
ROOT = "/workspace/project"
SMALL_KB = 4
TIMES = ("2024-01-31 08:00:00", "2024-01-31 09:01:35")
ONE_FILE = "src/src14/doc_14.ts"
REGION = (2, 6)
CUSTOM_RULE = Rule(rule_id="no-print", title="No print", severity="low", pattern=r"\bprint\s*\(", flags="g",
                   category="policy-violation", confidence=1.0, needs=("print",), description="Printing is for scripts.")
CUSTOM_ACTIVE = ("no-eval", "no-todo-comments", "no-print")

SIMPLE = ["finding_id", "category", "severity", "rule_id", "title", "description", "file_path", "start_line",
          "end_line", "match_ord", "snippet", "confidence", "recommendation", "cwe", "policy_rule"]
SIGNAL_COLUMNS = {
    "signal_entropy": "entropy_burstiness", "signal_comment_patterns": "comment_patterns",
    "signal_generic_identifiers": "generic_identifier_score", "signal_boilerplate": "boilerplate",
    "signal_structure": "structure_uniformity", "signal_comment_density": "comment_density",
    "signal_line_length": "line_length_uniformity",
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, as both engines print them."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scan(spark: SparkSession, d: str) -> Scan:
    return scan_files(corpus.files(spark, d))


def _kept(spark: SparkSession, d: str) -> Scan:
    """For results that need findings and scores more than once."""
    return keep(_scan(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Severity counts of all findings by language."""
    return rollup.severity_by_language(scan.scan_rules(corpus.files(spark, d), scan.catalog()))


def discover_files(spark, d):
    return src.discover(corpus.files(spark, d), ScanConfig(max_file_size_kb=SMALL_KB)).select("file_path", "size_bytes")


def list_files_query(spark, d):
    return src.list_files(corpus.files(spark, d), "SRC1")


def list_tree(spark, d):
    return src.list_tree(corpus.files(spark, d), "src", 2)


def file_exists(spark, d):
    wanted = corpus.table(spark, d, "labels").select(
        F.concat(F.lit("src/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                 F.lit(".ts")).alias("file_path"))
    return src.file_exists(corpus.files(spark, d), wanted)


def path_confinement(spark, d):
    return src.confine(corpus.path_targets(spark, d), ROOT)


def file_preview(spark, d):
    return src.preview(corpus.files(spark, d))


def region_slice(spark, d):
    return src.region(corpus.files(spark, d), *REGION).select("file_path", "code")


def region_findings(spark, d):
    return scan.vulnerability_findings(src.region(corpus.files(spark, d), *REGION)).select(*SIMPLE)


def language_loc(spark, d):
    return (author.language_and_lines(corpus.files(spark, d)).groupBy("language")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("lines_of_code").alias("lines_of_code")))


def vuln_findings(spark, d):
    return scan.vulnerability_findings(corpus.files(spark, d)).select(*SIMPLE)


def malicious_findings(spark, d):
    return scan.malicious_findings(corpus.files(spark, d)).select(*SIMPLE)


def policy_findings(spark, d):
    return scan.policy_findings(corpus.files(spark, d)).select(*SIMPLE)


def _one_policy(rule_id: str) -> Query:
    def run(spark, d):
        return scan.policy_findings(corpus.files(spark, d), [rule_id]).select(
            "file_path", "start_line", "snippet", "severity", "rule_id")
    return run


def all_findings(spark, d):
    return rounded(_scan(spark, d).findings.select(*SIMPLE))


def _signal(column: str) -> Query:
    def run(spark, d):
        return rounded(author.signals(corpus.files(spark, d), [column]))
    return run


def authorship_score(spark, d):
    return rounded(author.authorship(corpus.files(spark, d)).select(
        "file_path", "ai_score", "heuristic_score", "tier", "lines_total", "lines_ai"))


def authorship_interval(spark, d):
    return author.authorship(corpus.files(spark, d)).select("file_path", "interval_lo", "interval_hi")


def authorship_tiers(spark, d):
    scores = author.authorship(corpus.files(spark, d))
    return rounded(scores.groupBy("tier", author.score_band(F.col("ai_score")).alias("band"),
                                  author.score_label(F.col("ai_score")).alias("label"))
                   .agg(F.count(F.lit(1)).alias("files"), F.avg("ai_score").alias("mean_score")))


def ai_findings(spark, d):
    return rounded(author.authorship_findings(author.authorship(corpus.files(spark, d))).select(*SIMPLE))


def _picked(spark, d):
    return replies.pick_provider(corpus.score_replies(spark, d))


def score_requests(spark, d):
    return replies.score_requests(corpus.files(spark, d))


def provider_pick(spark, d):
    return _picked(spark, d)


def reply_parse(spark, d):
    return rounded(replies.parse_scores(_picked(spark, d)).select("file_path", "reply_score", "reply_reason"))


def blended_score(spark, d):
    return rounded(author.authorship(corpus.files(spark, d), replies=_picked(spark, d)).select(
        "file_path", "ai_score", "heuristic_score", "ai_analysis_score", "analysis_model", "ai_reason", "tier"))


def risk_score(spark, d):
    return rounded(rollup.risk_scores(scan.vulnerability_findings(corpus.files(spark, d))))


def file_results(spark, d):
    return rounded(_kept(spark, d).file_results())


def scan_summary(spark, d):
    return rounded(_kept(spark, d).summary())


def policy_status(spark, d):
    return policy.policy_status(scan.policy_findings(corpus.files(spark, d)))


def policy_scores(spark, d):
    files = corpus.files(spark, d)
    out = policy.policy_scores(files.filter(F.col("size_bytes").isNotNull()), scan.policy_findings(files))
    return out.withColumn("passed", F.array_join("passed", ","))


def compliance(spark, d):
    return policy.compliance(policy.policy_status(scan.policy_findings(corpus.files(spark, d))))


def custom_rules(spark, d):
    files = corpus.files(spark, d)
    rules = scan.remove_rule(scan.add_rule(POLICY_RULES, CUSTOM_RULE), "no-any-typescript")
    found = scan.policy_findings(files, CUSTOM_ACTIVE, rules)
    return policy.policy_status(found, CUSTOM_ACTIVE, rules)


def category_shares(spark, d):
    return rounded(rollup.category_shares(_scan(spark, d).findings))


def severity_shares(spark, d):
    return rounded(rollup.severity_shares(rollup.severity_counts(_scan(spark, d).findings)))


def top_findings(spark, d):
    return rounded(_scan(spark, d).top_findings().select(*SIMPLE))


def top_findings_per_file(spark, d):
    return rollup.first_findings_per_file(_scan(spark, d).findings).select(
        "file_path", "position", "rule_id", "start_line", "match_ord")


def top_ai_files(spark, d):
    return rounded(rollup.files_by_score(author.authorship(corpus.files(spark, d)), 20)
                   .select("file_path", "ai_score", "band"))


def search_findings(spark, d):
    rules = scan.narrowed(scan.catalog(), "vulnerability", "critical")
    found = scan.scan_rules(corpus.files(spark, d), rules)
    return rollup.search_findings(found, "vulnerability", "critical", " Token ").select(
        "finding_id", "file_path", "rule_id", "start_line")


def hide_false_positives(spark, d):
    found = _kept(spark, d).findings
    return rollup.search_findings(found, false_positives=corpus.false_positives(spark, d, found)).select(
        "finding_id", "file_path", "rule_id")


def visible_counts(spark, d):
    found = _kept(spark, d).findings
    marked = corpus.false_positives(spark, d, found)
    return rollup.visible_counts(found, rollup.search_findings(found, severity="high", false_positives=marked), marked)


def shell_risk(spark, d):
    return shell.analyze_commands(corpus.commands(spark, d)).select(
        "cmd_id", "risk_level", F.expr("array_join(transform(issues, x -> x.type || ':' || x.severity), ';')").alias("issues"),
        "suggestion")


def shell_guidance(spark, d):
    out = shell.apply_guidance(shell.analyze_commands(corpus.commands(spark, d)), corpus.guidance_replies(spark, d))
    return out.select("cmd_id", "risk_level", "suggestion", "safer_alternative")


def guidance_requests(spark, d):
    return shell.guidance_requests(shell.analyze_commands(corpus.commands(spark, d)))


def finding_context(spark, d):
    return context.finding_context(scan_files(corpus.files(spark, d), with_context=True).findings).select(
        "finding_id", "file_path", "start_line", "first_line", "last_line", "context")


def fix_requests(spark, d):
    return remedy.fix_requests(scan_files(corpus.files(spark, d), with_context=True).findings)


def _fixes(spark, d, found):
    """Replies of a model, one per finding."""
    answered = found.select("finding_id", corpus.pick(
        FIX_REPLIES, "(start_line + length(file_path))").alias("reply"))
    return remedy.validate_fixes(found, answered)


def fix_validation(spark, d):
    # findings are asked for by the fixes and by the replies
    return _fixes(spark, d, _kept(spark, d).findings)


def attach_fixes(spark, d):
    found = _kept(spark, d).findings
    return remedy.attach_fixes(found, _fixes(spark, d, found)).select("finding_id", "file_path", "sanitized_code")


def apply_fix(spark, d):
    return remedy.apply_fixes(corpus.files(spark, d), _fixes(spark, d, _kept(spark, d).findings), ROOT)


def written_fixes(spark, d):
    """Fixed files written back into a folder tree and read again."""
    root = f"{shared_folder(spark)}/fixed-{uuid.uuid4().hex}"
    tree.write_tree(apply_fix(spark, d), root)
    return tree.every_file(spark, root).select("file_path", "size_bytes", F.md5("code").alias("digest"))


def tree_files(spark, d):
    """What a project scan reads of a folder tree; size and folder are tested before a file is opened."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree.write_tree(corpus.files(spark, d), root)
    files = tree.read_tree(spark, root).filter(F.col("file_path").startswith("src/") & (F.col("size_bytes") <= SMALL_KB * 1024))
    return files.select("file_path", "size_bytes", F.md5("code").alias("digest"))


def single_file(spark, d):
    """Findings in one file, picked by its path."""
    return scan.vulnerability_findings(src.one_file(corpus.files(spark, d), ONE_FILE)).select(*SIMPLE)


def skipped_files(spark, d):
    return src.too_large(corpus.files(spark, d), ScanConfig(max_file_size_kb=SMALL_KB))


def severity_rollup(spark, d):
    return rollup.severity_rollup(scan.scan_rules(corpus.files(spark, d), scan.catalog()))


def scan_difference(spark, d):
    """Two states of a project: files come and go, and half of them get lines on top."""
    files = corpus.files(spark, d)
    moved = F.when(F.col("size_bytes") % 2 == 0, F.concat(F.lit("\n\n"), "code")).otherwise(F.col("code"))
    before = scan.vulnerability_findings(files.filter("size_bytes % 11 <> 0"))
    after = scan.vulnerability_findings(files.filter("size_bytes % 7 <> 0").withColumn("code", moved))
    return compare.compare_scans(before, after).select("status", "file_path", "rule_id", "ordinal", "old_line", "new_line")


def indexed_rules(spark, d):
    """Changed rules over a folder tree with a literal index: only files that can hold their literals are read again."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree.write_tree(corpus.files(spark, d), root)
    known = cut_lineage(index.literal_index(tree.every_file(spark, root)))
    rules = scan.active_rules(scan.add_rule(POLICY_RULES, CUSTOM_RULE), CUSTOM_ACTIVE)
    files = tree.read_paths(index.candidates(known, rules), root)
    return scan.scan_rules(files, rules).select("finding_id", "file_path", "rule_id", "start_line")


def _saves(spark, d):
    # a stream takes a folder or a pattern; the table may be a single file
    return corpus.saves(spark.readStream.schema(corpus.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet"))


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def distinct_saves(spark, d):
    """Each content that a user saved, once, from a stream."""
    out, state = _new_folder(spark, "saves"), _new_folder(spark, "state")
    first = events.first_saves(_saves(spark, d), ("folder",), delay="60 days").select("folder", "digest")
    events.run_available(first.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.schema("folder string, digest string").parquet(out)


def daily_findings(spark, d):
    """Findings per day of event time and severity, from a stream."""
    out, state = _new_folder(spark, "windows"), _new_folder(spark, "state")
    found = scan.scan_rules(_saves(spark, d), VULNERABILITY_RULES, ("ts",))
    events.run_available(events.keep_updates(events.window_counts(found), out, state))
    return events.last_updates(spark, out, ["begin", "end", "severity"]).select(
        F.date_format("begin", "yyyy-MM-dd").alias("day"), "severity", "findings")


def gated_days(spark, d):
    """Each day's findings against the mean of the first ten days; a stream of a few batches."""
    inbox, out, state = (_new_folder(spark, n) for n in ("inbox", "gate", "state"))
    saved = corpus.saves(corpus.table(spark, d, "events")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    saved.repartitionByRange(8, "day").write.parquet(inbox)
    first = scan.scan_rules(saved.filter("day <= '2024-01-10'"), VULNERABILITY_RULES)
    expected = cut_lineage(events.baseline(first, 10))
    stream = spark.readStream.schema(saved.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
    found = scan.scan_rules(stream, VULNERABILITY_RULES, ("day",))
    events.run_available(events.gated(found, out, state, lambda batch: events.gate(batch, F.col("day"), expected, 0.1, 1)))
    return rounded(spark.read.parquet(f"{out}/batch=*").withColumnRenamed("period", "day"))


def recommendations(spark, d):
    return _kept(spark, d).recommendations()


def report_lines(spark, d):
    return _kept(spark, d).report(PROJECT, TIMES)


def report_json(spark, d):
    return report.report_json(rounded(_kept(spark, d).summary()))


def scan_history(spark, d):
    """Two scans in one history table: everything, then what a project scan collects."""
    every = corpus.files(spark, d)
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    for files, scan_id, started in ((every, "b-first", "2024-01-01 00:00:00"),
                                    (src.discover(every), "a-second", "2024-01-02 00:00:00")):
        sinks.append_scan(author.language_and_lines(files), path, scan_id, started)
    return sinks.read_latest(spark, path).select("scan_id", "file_path", "language", "lines_of_code")


def project_summary(spark, d):
    """The summary of what a project scan collects."""
    files = src.discover(corpus.files(spark, d))
    return rounded(keep(scan_files(files)).summary())


QUERIES: dict[str, Query] = {
    "flagship_severity_by_language": flagship,
    "discover_files": discover_files,
    "list_files_query": list_files_query,
    "list_tree": list_tree,
    "file_exists": file_exists,
    "path_confinement": path_confinement,
    "file_preview": file_preview,
    "region_slice": region_slice,
    "region_findings": region_findings,
    "language_loc": language_loc,
    "vuln_findings": vuln_findings,
    "malicious_findings": malicious_findings,
    "policy_findings": policy_findings,
    "license_check": _one_policy("license-compliance"),
    "async_without_await": _one_policy("no-async-without-await"),
    "all_findings": all_findings,
    **{name: _signal(column) for name, column in SIGNAL_COLUMNS.items()},
    "authorship_score": authorship_score,
    "authorship_interval": authorship_interval,
    "authorship_tiers": authorship_tiers,
    "ai_findings": ai_findings,
    "score_requests": score_requests,
    "provider_pick": provider_pick,
    "reply_parse": reply_parse,
    "blended_score": blended_score,
    "risk_score": risk_score,
    "file_results": file_results,
    "scan_summary": scan_summary,
    "project_summary": project_summary,
    "scan_history": scan_history,
    "policy_status": policy_status,
    "policy_scores": policy_scores,
    "compliance": compliance,
    "custom_rules": custom_rules,
    "category_shares": category_shares,
    "severity_shares": severity_shares,
    "top_findings": top_findings,
    "top_findings_per_file": top_findings_per_file,
    "top_ai_files": top_ai_files,
    "search_findings": search_findings,
    "hide_false_positives": hide_false_positives,
    "visible_counts": visible_counts,
    "shell_risk": shell_risk,
    "shell_guidance": shell_guidance,
    "guidance_requests": guidance_requests,
    "finding_context": finding_context,
    "fix_requests": fix_requests,
    "fix_validation": fix_validation,
    "attach_fixes": attach_fixes,
    "apply_fix": apply_fix,
    "written_fixes": written_fixes,
    "tree_files": tree_files,
    "single_file": single_file,
    "skipped_files": skipped_files,
    "severity_rollup": severity_rollup,
    "scan_difference": scan_difference,
    "indexed_rules": indexed_rules,
    "distinct_saves": distinct_saves,
    "daily_findings": daily_findings,
    "gated_days": gated_days,
    "recommendations": recommendations,
    "report_lines": report_lines,
    "report_json": report_json,
}
