"""Policy results per file and per corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.catalog import POLICY_RULES, Rule
from codewarden.functions.text import round_half_up
from codewarden.operators.scan import active_rules, rules_table


def violations(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("category") == "policy-violation")


def policy_scores(scanned: DataFrame, findings: DataFrame, active: Sequence[str] | None = None,
                  rules: Sequence[Rule] = POLICY_RULES) -> DataFrame:
    """Rules each file passes and its score, 100 when no rule is active.

    ``scanned`` has a row for each file that was read, such as the scores.
    Findings shrink to one short set per file before they meet it.
    """
    ids = [r.rule_id for r in active_rules(rules, active)]
    broken = (violations(findings).groupBy("file_path")
              .agg(F.collect_set("rule_id").alias("broken"), F.count(F.lit(1)).alias("violations")))
    all_ids = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    passed = F.array_except(all_ids, F.coalesce("broken", F.array().cast("array<string>")))
    score = round_half_up(F.size("passed") / F.lit(len(ids)) * 100) if ids else F.lit(100)
    return (scanned.select("file_path")
            .join(broken, "file_path", "left")
            .select("file_path", F.coalesce("violations", F.lit(0)).alias("violations"), passed.alias("passed"))
            .withColumn("score", score.cast("int")))


def policy_status(findings: DataFrame, active: Sequence[str] | None = None,
                  rules: Sequence[Rule] = POLICY_RULES) -> DataFrame:
    """Every active rule with its number of violations, in catalog order."""
    chosen = active_rules(rules, active)
    table = rules_table(findings.sparkSession, chosen or rules)
    if not chosen:
        table = table.limit(0)
    ids = [r.rule_id for r in chosen]
    counts = (violations(findings).filter(F.col("rule_id").isin(ids))
              .groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")))
    # At most one count per chosen rule of the program, so that side is tiny.
    return table.join(F.broadcast(counts), "rule_id", "left").select(
        "rule_ord", "rule_id", F.col("title").alias("name"), "description",
        F.coalesce("n", F.lit(0)).alias("violations"))


def pass_band(percent: Column) -> Column:
    return F.when(percent >= 80, "low").when(percent >= 50, "medium").otherwise("critical")


def compliance(status: DataFrame) -> DataFrame:
    """Passing rules, violations and the pass rate; no row without a rule."""
    passing = F.count_if(F.col("violations") == 0)
    total = F.count(F.lit(1))
    return status.agg(
        total.alias("policies"), passing.alias("passing"),
        F.coalesce(F.sum("violations"), F.lit(0)).alias("total_violations"),
        round_half_up(passing / total * 100).cast("int").alias("percent"),
    ).filter(F.col("policies") > 0).withColumn("band", pass_band(F.col("percent")))
