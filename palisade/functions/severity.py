"""Severity scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower score bounds, best first.
SCORE_CUTS = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"))
CONFIDENCE_CUTS = ((0.9, "critical"), (0.75, "high"), (0.5, "medium"), (0.3, "low"))
CONFIDENCE_BOOST = {"dos_loop": 1.2, "backdoor_connection": 1.3}
SEVERITY_ORDER = ("critical", "high", "medium", "low")


def severity_from_scores(v3: Column, v2: Column) -> Column:
    """A zero version-3 score counts as absent, so version 2 decides."""
    score = F.when(v3 != 0, v3).otherwise(v2)
    level = F.when(score.isNull(), "medium")
    for bound, name in SCORE_CUTS:
        level = level.when(score >= bound, name)
    return level.when(score > 0, "low").otherwise("informational")


def severity_from_confidence(confidence: Column, kind: Column) -> Column:
    boosted = F.lit(None).cast("double")
    for name, factor in CONFIDENCE_BOOST.items():
        boosted = F.when(kind == name, F.least(F.lit(1.0), confidence * factor)).otherwise(boosted)
    value = F.coalesce(boosted, confidence)
    levels = [F.when(value >= bound, name) for bound, name in CONFIDENCE_CUTS]
    return F.coalesce(*levels, F.lit("informational"))


def severity_rank(severity: Column) -> Column:
    ranks = [F.when(severity == name, i) for i, name in enumerate(SEVERITY_ORDER, start=1)]
    return F.coalesce(*ranks, F.lit(len(SEVERITY_ORDER) + 1))
