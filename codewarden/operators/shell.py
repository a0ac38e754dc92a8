"""Risk of shell commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.catalog.shell import SHELL_RULES
from codewarden.config import ScanConfig
from codewarden.functions.severity import SEVERITY_RANK
from codewarden.functions.text import java, quoted
from codewarden.operators.replies import SHELL_MAX_TOKENS, WIDEST_OBJECT, _first, request_settings


def _issues() -> Column:
    """The rules that a command hits, in catalog order."""
    entries = ", ".join(
        f"CASE WHEN command RLIKE {quoted(java(r.pattern, r.flags))} THEN named_struct("
        f"'type', {quoted(r.issue_type)}, 'description', {quoted(r.description)}, "
        f"'severity', {quoted(r.severity)}, 'severity_rank', {SEVERITY_RANK[r.severity]}, "
        f"'suggestion', {quoted(r.suggestion)}) END"
        for r in SHELL_RULES
    )
    return F.expr(f"filter(array({entries}), x -> x IS NOT NULL)")


def _risk() -> Column:
    """Worst severity; none is ``info``, anything below medium is ``low``."""
    worst = F.expr("array_max(transform(issues, x -> x.severity_rank))")
    out = F.when(worst.isNull(), "info")
    for name in ("critical", "high", "medium"):
        out = out.when(worst == SEVERITY_RANK[name], name)
    return out.otherwise("low")


def analyze_commands(commands: DataFrame) -> DataFrame:
    """``commands(cmd_id, command)`` with issues, risk and the first suggestion."""
    return commands.withColumn("issues", _issues()).select(
        "cmd_id", "command", _risk().alias("risk_level"),
        F.expr("transform(issues, x -> named_struct('type', x.type, 'description', x.description, "
               "'severity', x.severity))").alias("issues"),
        F.expr("try_element_at(issues, 1).suggestion").alias("suggestion"),
    )


def guidance_requests(analyzed: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Requests for the commands that have an issue; clean ones are not asked about."""
    tokens, temperature = request_settings(SHELL_MAX_TOKENS, config)
    issues = F.expr("array_join(transform(issues, x -> x.description), '; ')")
    return analyzed.filter(F.size("issues") > 0).select(
        "cmd_id",
        F.concat(F.lit("Say how this shell command can be made safer.\n\nCommand: "), F.col("command"),
                 F.lit("\nIssues found: "), issues,
                 F.lit('\n\nAnswer with JSON only: {"suggestion": "<short tip>", '
                       '"saferAlternative": "<command or null>"}')).alias("prompt"),
        tokens.alias("max_tokens"), temperature.alias("temperature"),
    )


def apply_guidance(analyzed: DataFrame, replies: DataFrame) -> DataFrame:
    """Merge ``replies(cmd_id, reply)`` into the analysis.

    A failed call (no row, or a null reply) leaves the built-in suggestion; a
    reply that is not JSON leaves none.  Clean commands are never asked about.
    """
    asked = F.size("issues") > 0
    failed = F.col("reply").isNull()
    parsed = F.try_parse_json(_first(F.col("reply"), WIDEST_OBJECT))
    return analyzed.join(replies.select("cmd_id", "reply"), "cmd_id", "left").select(
        "cmd_id", "command", "risk_level", "issues",
        F.when(asked & ~failed, F.try_variant_get(parsed, "$.suggestion", "string"))
        .otherwise(F.col("suggestion")).alias("suggestion"),
        F.when(asked & ~failed, F.try_variant_get(parsed, "$.saferAlternative", "string")).alias("safer_alternative"),
    )
