"""Severity ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank and risk weight of each severity.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
RISK_WEIGHT = {"critical": 10, "high": 7, "medium": 4, "low": 1, "info": 0}


def _lookup(values: dict[str, int], key: Column) -> Column:
    out = F.lit(0)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return _lookup(SEVERITY_RANK, severity)


def risk_weight(severity: Column) -> Column:
    return _lookup(RISK_WEIGHT, severity)


def severity_name(rank: Column) -> Column:
    """The severity of a rank; a missing rank is ``info``."""
    out = F.lit("info")
    for name, value in SEVERITY_RANK.items():
        out = F.when(rank == value, F.lit(name)).otherwise(out)
    return out
