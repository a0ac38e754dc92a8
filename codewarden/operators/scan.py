"""Findings of the rule catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.catalog import MALICIOUS_RULES, POLICY_RULES, VULNERABILITY_RULES, Rule
from codewarden.functions.severity import SEVERITY_RANK, severity_rank
from codewarden.functions.text import quoted
from codewarden.operators.context import CONTEXT_COLUMNS
from codewarden.operators.matching import find_all
from codewarden.schema import FINDING_COLUMNS, INDICATOR

_RULE_COLUMNS = ("rule_ord", "rule_id", "category", "sub_category", "title", "severity", "severity_rank",
                 "cwe", "confidence", "description", "recommendation")


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, float):
        return f"{value}D"
    return quoted(value) if isinstance(value, str) else str(value)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A catalog as a table.  Its size is the number of rules in the program."""
    rows = ",\n".join(
        "(" + ", ".join(_literal(v) for v in (
            i, r.rule_id, r.category, r.sub_category, r.title, r.severity, SEVERITY_RANK[r.severity],
            r.cwe, float(r.confidence), r.description, r.recommendation)) + ")"
        for i, r in enumerate(rules)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(_RULE_COLUMNS)})")


def active_rules(rules: Sequence[Rule], active: Sequence[str] | None) -> list[Rule]:
    """None keeps every rule, an empty list none."""
    return [r for r in rules if active is None or r.rule_id in active]


def add_rule(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    """The catalog with ``rule`` in it; a rule of the same id is replaced in place."""
    if any(r.rule_id == rule.rule_id for r in rules):
        return [rule if r.rule_id == rule.rule_id else r for r in rules]
    return [*rules, rule]


def remove_rule(rules: Sequence[Rule], rule_id: str) -> list[Rule]:
    return [r for r in rules if r.rule_id != rule_id]


def finding_id() -> Column:
    """The same finding has the same id in every run."""
    return F.sha2(F.concat_ws("|", "category", "rule_id", "file_path",
                              F.col("start_line").cast("string"), F.col("match_ord").cast("string")), 256)


def as_findings(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bring rows into the layout of the findings table."""
    optional = {
        "severity_rank": severity_rank(F.col("severity")),
        "end_line": F.col("start_line"),
        "policy_rule": F.when(F.col("category") == "policy-violation", F.col("rule_id")),
        "indicators": F.lit(None).cast(f"array<{INDICATOR.simpleString()}>"),
        "ai_reason": F.lit(None).cast("string"),
        "finding_id": finding_id(),
    }
    have = set(rows.columns)
    return rows.select(*[c if c in have else optional[c].alias(c) for c in FINDING_COLUMNS], *keep)


def narrowed(rules: Sequence[Rule], category: str = "all", severity: str = "all") -> list[Rule]:
    """The rules whose findings a filter can show; the others need not run."""
    return [r for r in rules if category in ("all", r.category) and severity in ("all", r.severity)]


def scan_rules(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = (), context: bool = False) -> DataFrame:
    """Every finding of ``rules``, in one pass over the text.

    ``keep`` names columns of the files to carry along; with ``context`` each
    finding has the lines around it.
    """
    if not rules:
        rules_df = rules_table(files.sparkSession, VULNERABILITY_RULES[:1])
    else:
        rules_df = rules_table(files.sparkSession, rules)
    found = find_all(files, rules, keep, context)
    return as_findings(found.join(F.broadcast(rules_df), "rule_ord"), (*keep, *(CONTEXT_COLUMNS if context else ())))


def vulnerability_findings(files: DataFrame) -> DataFrame:
    return scan_rules(files, VULNERABILITY_RULES)


def malicious_findings(files: DataFrame) -> DataFrame:
    return scan_rules(files, MALICIOUS_RULES)


def policy_findings(files: DataFrame, active: Sequence[str] | None = None,
                    rules: Sequence[Rule] = POLICY_RULES) -> DataFrame:
    return scan_rules(files, active_rules(rules, active))


def catalog(active: Sequence[str] | None = None, rules: Sequence[Rule] = POLICY_RULES) -> list[Rule]:
    """All rules of a scan: vulnerability, malicious code, active policies."""
    return [*VULNERABILITY_RULES, *MALICIOUS_RULES, *active_rules(rules, active)]
