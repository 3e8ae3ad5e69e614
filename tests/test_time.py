from datetime import datetime

from pyspark.sql import functions as F

from factlake.functions import temporal
from factlake.operators.intent import plan_temporal_queries, validate_model_plan


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_grain_of_facts_and_queries(spark):
    def valid(start, end, grain, at, query_grain):
        return one(spark, v=temporal.valid_as_of(ts(start), F.lit(None).cast("timestamp_ntz") if end is None else ts(end), F.lit(grain), ts(at), F.lit(query_grain)))["v"]

    assert valid("2026-03-15", None, "month", "2026-03-01", "day")
    assert not valid("2026-03-15", None, "day", "2026-03-01", "day")
    assert valid("2026-03-20", "2026-03-25", "day", "2026-03-15", "month")
    assert not valid("2026-03-20", "2026-03-25", "day", "2026-03-15", "day")
    assert valid("2026-02-01", "2026-03-02", "day", "2026-03-15", "month")
    assert one(spark, v=temporal.expand_valid_from(ts("2026-05-20"), F.lit("Quarter ")))["v"] == datetime(2026, 4, 1)


def test_belief_window_is_half_open(spark):
    row = one(
        spark,
        a=temporal.believed_as_of(ts("2026-01-01"), ts("2026-02-01"), ts("2026-02-01")), b=temporal.believed_as_of(ts("2026-01-01"), ts("2026-02-01"), ts("2026-01-01")),
        c=temporal.believed_as_of(ts("2026-01-01"), F.lit(None).cast("timestamp_ntz"), ts("2030-01-01")),
    )
    assert tuple(row) == (False, True, True)


def test_relative_phrases(spark):
    cases = {
        "2 weeks ago": (datetime(2026, 6, 1), "day"), "3 months ago": (datetime(2026, 3, 15), "month"), "last summer": (datetime(2025, 7, 15), "month"), "a few weeks ago": (datetime(2026, 5, 25), "day"),
        "Yesterday evening": (datetime(2026, 6, 14), "day"), "this year": (datetime(2026, 1, 1), "year"), "last winter": (datetime(2026, 1, 15), "month"), "soon": (None, None), "99999999999 days ago": (None, "day"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "phrase string")
    at, grain = temporal.relative_phrase(F.col("phrase"), ts("2026-06-15"))
    got = {r["phrase"]: (r["at"], r["grain"]) for r in df.select("phrase", at.alias("at"), grain.alias("grain")).collect()}
    assert got == cases


def test_intent(spark):
    cases = {
        "Who was her manager in March 2026?": ("world", datetime(2026, 3, 15), None, "ok"), "what did we report in March 2026": ("belief", datetime(2026, 3, 15), None, "ok"),
        "team in Q1 2026": ("world", datetime(2026, 2, 15), None, "ok"), "what changed between March and June 2026": ("world", datetime(2026, 3, 15), datetime(2026, 6, 15), "ok"),
        "as of the reorg": ("world", None, None, "ambiguous"), "what changed between then and now": ("world", None, None, "ambiguous"), "": ("current", None, None, "ok"), None: ("current", None, None, "ok"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "query string")
    rows = plan_temporal_queries(df, ts("2026-07-01")).collect()
    assert {r["query"]: (r["axis"], r["point"], r["range_end"], r["status"]) for r in rows} == cases


def test_model_plans_are_checked(spark):
    df = spark.createDataFrame([("world", None, 0.9), ("current", None, 1.7), ("odd", datetime(2020, 1, 1), 0.2)], "axis string, point timestamp_ntz, confidence double")
    got = [(r["axis"], r["status"], r["confidence"]) for r in validate_model_plan(df).collect()]
    assert got == [("world", "ambiguous", 0.3), ("current", "ok", 1.0), ("current", "ambiguous", 0.2)]


def test_iso_and_day_bounds(spark):
    df = spark.createDataFrame([("2024-02-03",), ("2024-02-03T04:05",), ("3 Feb",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(temporal.iso_instant(F.col("t"))).collect()] == [True, True, False, False]
    s, e = temporal.day_bounds(F.lit("2024-02-03"))
    assert tuple(one(spark, s=s, e=e)) == (datetime(2024, 2, 3), datetime(2024, 2, 3, 23, 59, 59, 999999))
