"""Scores: decay, freshness, precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reciprocal rank constant; half-lives in days and floors of passages and facts.
RRF_K = 60
PASSAGE_HALF_LIFE, PASSAGE_FLOOR = 90.0, 0.3
FACT_HALF_LIFE, FACT_FLOOR = 180.0, 0.25
#: Names of the precedence ranks, from 1.
PRECEDENCE = ("extraction_single", "extraction_multi", "agent_promote", "ground_truth")


def age_days(at: Column, now: Column) -> Column:
    seconds = now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    return F.greatest(seconds / 86400.0, F.lit(0.0))


def recency_multiplier(at: Column, now: Column, half_life, floor) -> Column:
    """0.5 to the age in half-lives, at least ``floor``; without a time the floor."""
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    least = F.lit(float(floor))
    return F.coalesce(F.greatest(F.pow(F.lit(0.5), age_days(at, now) / half), least), least)


def fact_freshness(confidence: Column, at: Column, now: Column, half_life: Column | float = FACT_HALF_LIFE, floor: float = FACT_FLOOR) -> Column:
    return confidence * recency_multiplier(at, now, half_life, floor)


def precedence_rank(created_by: Column, evidence_count: Column) -> Column:
    return (
        F.when(created_by.startswith("structured_field"), 4).when(created_by.startswith("agent_promote"), 3)
        .when(evidence_count >= 2, 2).otherwise(1)
    )


def precedence_class(rank: Column) -> Column:
    out = F.lit(PRECEDENCE[0])
    for i, name in enumerate(PRECEDENCE[1:], 2):
        out = F.when(rank == i, name).otherwise(out)
    return out


def status_for_confidence(confidence: Column, threshold: float = 0.8) -> Column:
    return F.when(confidence >= threshold, "active").otherwise("proposed")


def parse_confidence(raw: Column) -> Column:
    """A number in 0 to 1, also from text; else null."""
    n = F.trim(raw).try_cast("double")
    return F.when(n.between(0.0, 1.0), n)
