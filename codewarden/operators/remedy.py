"""From a finding to a fix: context, request, check of the reply, rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.config import ScanConfig
from codewarden.functions.dialect import SPACE_CHARS
from codewarden.functions.paths import is_inside, resolve_against
from codewarden.functions.text import java, trim_all
from codewarden.operators.context import finding_context
from codewarden.operators.replies import FIX_MAX_TOKENS, request_settings

# The reply check.
QUOTED_CHARS = 40
FENCED_BLOCK = r"```[a-z]*\n([\s\S]+?)```"
NOT_CODE = ("suggested fix", "% confidence", "policy violation")


def fix_requests(findings: DataFrame, files: DataFrame | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """One request per finding, with the whole of its function."""
    tokens, temperature = request_settings(FIX_MAX_TOKENS, config)
    c = F.col
    return finding_context(findings, files).select(
        "finding_id",
        F.concat(
            F.lit("Repair this problem in a piece of source code.\n\nProblem: "), c("title"),
            F.lit("\nKind: "), c("category"), F.lit("\nSeverity: "), c("severity"),
            F.lit("\nDetails: "), c("description"),
            F.lit("\nAdvice: "), F.coalesce("recommendation", F.lit("Use the safe idiom of the language")),
            F.lit("\n\nLines "), c("start_line").cast("string"), F.lit(" to "), c("end_line").cast("string"),
            F.lit(":\n```\n"), c("snippet"),
            F.lit("\n```\n\nSurrounding function:\n```\n"), c("context"),
            F.lit("\n```\n\nAnswer with one fenced block that replaces the quoted lines. Keep lines that are not "
                  "part of the problem, keep the indentation, and explain nothing outside the block.")).alias("prompt"),
        tokens.alias("max_tokens"), temperature.alias("temperature"),
    )


def validate_fixes(findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Accept or reject ``replies(finding_id, reply)``.

    ``reject_reason`` is null for an accepted reply, whose block becomes
    ``sanitized_code``.
    """
    block = F.regexp_extract("reply", java(FENCED_BLOCK), 1)
    joined = (findings.select("finding_id", "file_path", "start_line", "end_line", "title", "description")
              .join(replies.select("finding_id", "reply"), "finding_id")
              .withColumn("fenced", F.col("reply").rlike(java(FENCED_BLOCK)))
              .withColumn("block", trim_all(block)))
    low = F.lower("block")
    signs = [F.lower("title"), F.lower(F.left("description", F.lit(QUOTED_CHARS))), *[F.lit(w) for w in NOT_CODE]]
    is_prose = F.lit(False)
    for sign in signs:
        is_prose = is_prose | F.contains(low, sign)
    reason = (F.when(F.col("reply").isNull(), "call failed")
              .when(~F.col("fenced"), "no code block")
              .when(is_prose, "description instead of code"))
    return joined.withColumn("reject_reason", reason).select(
        "finding_id", "file_path", "start_line", "end_line", "reject_reason",
        F.when(F.col("reject_reason").isNull(), F.col("block")).alias("sanitized_code"))


def attach_fixes(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """Findings with ``sanitized_code`` where a fix was accepted."""
    accepted = fixes.filter(F.col("reject_reason").isNull()).select("finding_id", "sanitized_code")
    return findings.join(accepted, "finding_id", "left")


def _indent(line: Column) -> Column:
    return F.regexp_extract(line, java(r"^(\s*)"), 1)


def _rewritten(lines: Column, fixes: Column) -> Column:
    """The lines with the fixes in place, top down; a fix that starts inside an earlier one is a conflict.

    First the fixes are chosen, from their line numbers alone; then the pieces, kept lines and blocks by turns, are cut out
    and put together once.
    """
    last = F.size(lines)
    numbered = F.transform(fixes, lambda x, i: F.struct(i.alias("i"), x["from"].alias("from"), F.greatest(F.least(last, x["end_line"]), x["from"]).alias("to")))
    # where the text goes on after each fix that is taken; a refused one has none
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate(numbered, start, lambda s, x: F.when(x["from"] >= s["at"], F.struct(
        x["to"].alias("at"), F.concat(s["taken"], F.array(x["i"])).alias("taken"))).otherwise(s), lambda s: s["taken"])

    def put(chosen: Column) -> Column:
        def piece(at: Column, k: Column) -> Column:
            fix = F.get(fixes, at)
            before = F.get(numbered, F.get(chosen, k - 1))["to"]
            base = _indent(F.coalesce(F.get(lines, fix["from"]), F.lit("")))
            deeper = F.length(base) > F.length(_indent(F.get(fix["block"], F.lit(0))))
            block = F.when(deeper, F.transform(fix["block"], lambda x: F.concat(base, F.ltrim(x, F.lit(SPACE_CHARS))))).otherwise(fix["block"])
            begin = F.coalesce(before, F.lit(0))
            return F.concat(F.slice(lines, begin + 1, F.greatest(fix["from"] - begin, F.lit(0))), block)

        end = F.coalesce(F.get(numbered, F.get(chosen, F.size(chosen) - 1))["to"], F.lit(0))
        rest = F.slice(lines, end + 1, F.greatest(last - end, F.lit(0)))
        out = F.flatten(F.concat(F.transform(chosen, piece), F.array(rest)))
        refused = F.filter(fixes, lambda x, i: ~F.array_contains(chosen, i))
        return F.struct(out.alias("out"), F.size(chosen).alias("n"), F.transform(refused, lambda x: x["finding_id"]).alias("conflicts"))

    return F.transform(F.array(taken), put)[0]


def apply_fixes(files: DataFrame, fixes: DataFrame, root: str = "/workspace") -> DataFrame:
    """Rewrite each file that has a fix, with all of its fixes at once.

    ``fixes(finding_id, file_path, start_line, end_line, sanitized_code)``.
    Returns ``file_path, applied, conflicts, code`` of the rewritten files:
    how many fixes were put in, and the ids of those that overlap an earlier
    one, which stay out.  Paths that lead out of ``root`` are refused.  Only
    files with a fix take part in the join.
    """
    lines = F.split("sanitized_code", "\r?\n", -1)
    chosen = (fixes.filter(F.col("sanitized_code").isNotNull())
              .filter(is_inside(F.lit(root), resolve_against(F.lit(root), F.col("file_path"))))
              .groupBy("file_path")
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.greatest(F.lit(0), F.col("start_line") - 1).alias("from"), "end_line", "finding_id",
                  lines.alias("block")))).alias("fixes")))
    eol = F.when(F.contains("code", F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))
    return (files.filter(F.col("code").isNotNull())
            .select("file_path", F.split("code", "\r?\n", -1).alias("lines"), eol.alias("eol")).join(chosen, "file_path")
            .select("file_path", "eol", _rewritten(F.col("lines"), F.col("fixes")).alias("r"))
            .select("file_path", F.col("r.n").alias("applied"), F.array_join("r.conflicts", ",").alias("conflicts"),
                    F.expr("array_join(r.out, eol)").alias("code")))
