"""Temporal intent of a query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.temporal import between_points, calendar_point

#: The words that show what a query asks for.
BELIEF = r"\b(what did we (think|believe|report|know)|before the correction|as of our records|according to (the )?(old |previous )?(wiki|records|system)|what (was|were) (we|the system) (showing|reporting))\b"
BETWEEN = r"\b(what\s+changed|changes?|difference|diff)\b.*\bbetween\b"
SOFT = (r"\bas of\b", r"\b(during (the )?(reorg|reorganization|transition)|when (she|he|they) was)\b")
CURRENT = r"\b(now|current|currently|today|who is|what is)\b"


def plan_temporal_queries(queries: DataFrame, now: Column) -> DataFrame:
    """Axis, point, range end, grain, status, confidence and rationale of each ``query``; the first rule that fits counts."""
    text = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    point, grain = calendar_point(text, now)
    start, end, pair_grain = between_points(text, now)
    rows = queries.withColumns({
        "_empty": text == "", "_belief": text.rlike(BELIEF), "_between": text.rlike(BETWEEN), "_soft": text.rlike(SOFT[0]) | text.rlike(SOFT[1]), "_current": text.rlike(CURRENT),
        "_point": point, "_grain": grain, "_start": start, "_end": end, "_pair": pair_grain,
    })
    b, axis = F.col("_belief"), F.when(F.col("_belief"), "belief").otherwise("world")
    none = F.lit(None)
    # (condition, axis, point, range end, grain, status, confidence, rationale)
    rules = [
        (F.col("_empty"), F.lit("current"), none, none, none, "ok", F.lit(1.0), F.lit("empty")),
        (F.col("_between") & F.col("_start").isNull(), axis, none, none, none, "ambiguous", F.lit(0.25), F.lit("between_without_points")),
        (F.col("_between"), axis, F.col("_start"), F.col("_end"), F.col("_pair"), "ok", F.when(b, 0.85).otherwise(0.9), F.concat(axis, F.lit("_diff"))),
        (b & F.col("_point").isNull(), F.lit("belief"), none, none, none, "ambiguous", F.lit(0.2), F.lit("belief_without_point")),
        (b, F.lit("belief"), F.col("_point"), none, F.col("_grain"), "ok", F.lit(0.85), F.lit("belief_point")),
        (F.col("_point").isNotNull(), F.lit("world"), F.col("_point"), none, F.col("_grain"), "ok", F.lit(0.9), F.lit("world_point")),
        (F.col("_soft"), F.lit("world"), none, none, none, "ambiguous", F.lit(0.3), F.lit("world_without_point")),
        (F.lit(True), F.lit("current"), none, none, none, "ok", F.when(F.col("_current"), 0.95).otherwise(0.8), F.lit("current")),
    ]
    names = ("axis", "point", "range_end", "grain", "status", "confidence", "rationale")
    kinds = ("string", "timestamp_ntz", "timestamp_ntz", "string", "string", "double", "string")
    out = {}
    for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        value = F.lit(None).cast(kind)
        for rule in reversed(rules):
            v = rule[k + 1]
            value = F.when(rule[0], (F.lit(v) if isinstance(v, str) else v).cast(kind)).otherwise(value)
        out[name] = value
    return rows.withColumns(out).drop("_empty", "_belief", "_between", "_soft", "_current", "_point", "_grain", "_start", "_end", "_pair")


def passage_clocks(plans: DataFrame) -> DataFrame:
    """Bounds on passages from each plan's points; bounds that the host gave (host_event_to, host_updated_to) win."""
    host = lambda c: F.col(c) if c in plans.columns else F.lit(None).cast("timestamp_ntz")
    given = host("host_event_to").isNotNull() | host("host_updated_to").isNotNull()
    source = F.when(given, "host").when(F.col("as_of").isNotNull(), "world").when(F.col("believed_as_of").isNotNull(), "belief").otherwise("none")
    return plans.withColumns({"event_to": F.coalesce(host("host_event_to"), "as_of"), "updated_to": F.coalesce(host("host_updated_to"), "believed_as_of"), "derived_from": source})


def validate_model_plan(plans: DataFrame) -> DataFrame:
    """Plans from a model: an unknown axis or a missing point makes them ambiguous, with little confidence."""
    known = F.coalesce(F.col("axis").isin("current", "world", "belief"), F.lit(False))
    pointless = (F.col("axis") != "current") & F.col("point").isNull()
    bad = ~known | pointless
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return plans.withColumns({"axis": F.when(known, F.col("axis")).otherwise("current"), "status": F.when(bad, "ambiguous").otherwise("ok"), "confidence": F.when(bad, F.least(sure, F.lit(0.3))).otherwise(sure)})
