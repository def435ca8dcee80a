"""Severity, source and status orders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the highest rank 5 to 1.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Informational")
#: Trust in the tool that found a row; unknown tools have 0.
SOURCE_RANK = {"semgrep": 4, "osv": 4, "gitleaks": 4, "npm-audit": 3, "taint": 3, "structural": 3, "redos": 3, "llm": 2, "llm-logic": 2, "builtin": 1}
#: Exploitation status by rank.
EXPLOITATION_RANK = {"exploited": 3, "elevated": 2, "listed": 1, "unknown": 0, "": 0}


def ranked(value: Column, ranks: dict[str, int], default: int = 0) -> Column:
    out = F.lit(default)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return ranked(severity, {s: 5 - i for i, s in enumerate(SEVERITIES)})


def lowered(severity: Column, rungs: int | Column) -> Column:
    """The severity some rungs further down, at the floor at most; unknown severities stay."""
    ladder = F.array(*map(F.lit, SEVERITIES))
    place = F.array_position(ladder, severity)
    return F.when(place > 0, F.element_at(ladder, F.least(F.lit(len(SEVERITIES)), place + rungs).cast("int"))).otherwise(severity)


def by_confidence(severity: Column, confidence: Column) -> Column:
    """One rung down unless confidence is high."""
    return F.when(confidence == "high", severity).otherwise(lowered(severity, 1))


def by_verdict(severity: Column, vex_status: Column) -> Column:
    """Two rungs down when not affected."""
    return F.when(vex_status == "not_affected", lowered(severity, 2)).otherwise(severity)


def source_rank(source: Column) -> Column:
    return ranked(source, SOURCE_RANK)


def score_band(score: Column) -> Column:
    """Severity of a numeric score given as text; what is no number is Medium."""
    x = score.try_cast("double")
    return F.when(x.isNull(), "Medium").when(x >= 9, "Critical").when(x >= 7, "High").when(x >= 4, "Medium").otherwise("Low")
