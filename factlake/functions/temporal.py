"""Time columns: grains, buckets, validity, belief, and phrases about time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grains, from fine to coarse.
GRAINS = ("day", "month", "quarter", "year", "unknown")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def floor_to(instant: Column, unit: str) -> Column:
    return F.date_trunc(unit, instant).cast("timestamp_ntz")


def plus_months(instant: Column, months: Column) -> Column:
    """Calendar shift that keeps the time of day; the day is clamped to the month."""
    return instant + F.make_ym_interval(F.lit(0), months)


def normalize_grain(grain: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(grain, F.lit("unknown"))))
    return F.when(clean.isin(*GRAINS), clean).otherwise(F.lit("unknown"))


def host_grain(grain: Column) -> tuple[Column, Column]:
    """(grain, ok): blank is null; an unknown word is not ok."""
    clean = F.nullif(F.lower(F.trim(grain)), F.lit(""))
    ok = clean.isNull() | clean.isin(*GRAINS)
    return F.when(ok, clean), ok


def expand_valid_from(valid_from: Column, grain: Column) -> Column:
    g = normalize_grain(grain)
    out = F.when(g == "month", floor_to(valid_from, "month")).when(g == "quarter", floor_to(valid_from, "quarter"))
    return out.when(g == "year", floor_to(valid_from, "year")).otherwise(valid_from)


def query_bucket(as_of: Column, grain: Column) -> tuple[Column, Column]:
    """[start, end) of the calendar bucket; null for day and unknown."""
    g = normalize_grain(grain)
    start = end = None
    for unit, months in (("month", 1), ("quarter", 3), ("year", 12)):
        s = floor_to(as_of, unit)
        e = plus_months(s, F.lit(months))
        start = F.when(g == unit, s) if start is None else start.when(g == unit, s)
        end = F.when(g == unit, e) if end is None else end.when(g == unit, e)
    return start, end


def valid_as_of(valid_from: Column, valid_to: Column, fact_grain: Column, as_of: Column, grain: Column) -> Column:
    """The fact's world window holds the point, or meets its bucket."""
    start, end = query_bucket(as_of, grain)
    first = expand_valid_from(valid_from, fact_grain)
    meets = (first.isNull() | (first < end)) & (valid_to.isNull() | (valid_to > start))
    holds = (first.isNull() | (first <= as_of)) & (valid_to.isNull() | (valid_to > as_of))
    return F.when(start.isNotNull(), meets).otherwise(holds)


def believed_as_of(recorded_at: Column, invalidated_at: Column, at: Column) -> Column:
    return (recorded_at <= at) & (invalidated_at.isNull() | (invalidated_at > at))


def resolve_point(as_of: Column, believed: Column, grain: Column, now: Column) -> tuple[Column, Column, Column]:
    """(instant, grain, is_point): as_of wins; belief alone reads the world at the belief instant; else now."""
    instant = F.coalesce(as_of, believed, now)
    g = F.when(as_of.isNotNull(), F.coalesce(grain, F.lit("unknown"))).otherwise(F.lit("day"))
    return instant, g, as_of.isNotNull() | believed.isNotNull()


def read_statuses(is_point: Column) -> Column:
    return F.when(is_point, F.array(F.lit("active"), F.lit("superseded"))).otherwise(F.array(F.lit("active")))


def grain_rank(grain: Column) -> Column:
    """The finer the smaller; unknown is the coarsest."""
    g = normalize_grain(grain)
    out = F.lit(len(GRAINS) - 1)
    for i, name in enumerate(GRAINS[:-1]):
        out = F.when(g == name, i).otherwise(out)
    return out


def finer_grain(a: Column, b: Column) -> Column:
    return F.when(grain_rank(a) <= grain_rank(b), normalize_grain(a)).otherwise(normalize_grain(b))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First and last instant of a date."""
    start = floor_to(F.to_timestamp(day), "day")
    return start, start + F.expr("interval '1' day") - F.expr("interval '0.000001' second")


def iso_instant(text: Column) -> Column:
    """A timestamp where the text is an ISO date or instant; else null."""
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    clean = F.trim(text)
    return F.when(clean.rlike(iso), F.try_to_timestamp(clean)).cast("timestamp_ntz")


def relative_phrase(text: Column, ref: Column) -> tuple[Column, Column]:
    """(instant, grain) of a phrase about time, seen from ``ref``; the first rule that matches counts."""
    t = F.lower(text)

    def ago(unit: str) -> tuple[Column, Column]:
        pattern = rf"\b([0-9]+)\s+{unit}s?\s+ago\b"
        return t.rlike(pattern), F.regexp_extract(t, pattern, 1).try_cast("int")

    def days(n: Column) -> Column:
        return ref - F.make_dt_interval(n)

    def has(words: str) -> Column:
        return t.rlike(rf"\b{words}\b")

    year, month = F.year(ref), F.month(ref)

    def date(y: Column, m: int) -> Column:
        return F.make_timestamp_ntz(y, F.lit(m), F.lit(15), F.lit(0), F.lit(0), F.lit(0))

    rules = [(has(r"a\s+few\s+weeks?\s+ago"), days(F.lit(21)), "day")]
    for unit, shift, grain in (
        ("week", lambda n: days(n * 7), "day"), ("day", days, "day"),
        ("month", lambda n: plus_months(ref, -n), "month"), ("year", lambda n: plus_months(ref, -12 * n), "year"),
    ):
        match, n = ago(unit)
        rules.append((match, shift(n), grain))
    rules += [
        (has("yesterday"), days(F.lit(1)), "day"), (has("today"), ref, "day"), (has(r"last\s+week"), days(F.lit(7)), "day"),
        (has(r"last\s+month"), plus_months(ref, F.lit(-1)), "month"), (has(r"last\s+year"), plus_months(ref, F.lit(-12)), "year"),
        (has(r"this\s+month"), floor_to(ref, "month"), "month"), (has(r"this\s+year"), floor_to(ref, "year"), "year"),
        (has(r"last\s+summer"), date(F.when(month >= 9, year).otherwise(year - 1), 7), "month"),
        (has(r"last\s+winter"), date(F.when(month >= 3, year).otherwise(year - 1), 1), "month"),
    ]
    instant, grain = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    for match, value, g in reversed(rules):
        instant, grain = F.when(match, value).otherwise(instant), F.when(match, g).otherwise(grain)
    return instant, grain


def ground_times(valid_from: Column, valid_to: Column, phrase: Column, grain: Column, ref: Column) -> tuple[Column, Column, Column, Column]:
    """(from, to, grain, ok) of a fact's own times, which are texts, seen from ``ref``.

    An ISO time counts, else the phrase, else ``ref`` itself; a grain that
    isn't given is the phrase's, or day for ``ref``. A window that ends before
    it begins is not ok.
    """
    told, until, g = iso_instant(valid_from), iso_instant(valid_to), normalize_grain(grain)
    said, said_grain = relative_phrase(phrase, ref)
    start = F.coalesce(told, said, ref)
    fallback = F.when(told.isNull() & said.isNotNull(), said_grain).when(told.isNull(), F.lit("day")).otherwise(F.lit("unknown"))
    return start, until, F.when(g == "unknown", fallback).otherwise(g), F.coalesce(start <= until, F.lit(True))


def calendar_point(text: Column, clock: Column) -> tuple[Column, Column]:
    """(instant, grain): quarter, month or year that the text names; a missing year is the clock's."""
    t = F.lower(text)
    names = "|".join(MONTHS)

    def pick(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))

    def at(y: Column, m: Column, d: int) -> Column:
        return F.make_timestamp_ntz(y, m, F.lit(d), F.lit(0), F.lit(0), F.lit(0))

    quarter_re, in_month_re = r"\bin q([1-4])(?:\s+(20[0-9]{2}))?\b", rf"\bin ({names})(?:\s+(20[0-9]{{2}}))?\b"
    month_re, in_year_re, year_re = rf"\b({names})(?:\s+(20[0-9]{{2}}))?\b", r"\bin (20[0-9]{2})\b", r"\b(20[0-9]{2})\b"
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    quarter = (pick(quarter_re, 1).cast("int") - 1) * 3 + 2

    def year(pattern: str, group: int) -> Column:
        return F.coalesce(pick(pattern, group).cast("int"), F.year(clock))

    instant, grain = F.lit(None).cast("timestamp_ntz"), F.lit("unknown")
    for match, value, g in reversed([
        (t.rlike(quarter_re), at(year(quarter_re, 2), quarter, 15), "quarter"),
        (t.rlike(in_month_re), at(year(in_month_re, 2), number[pick(in_month_re, 1)], 15), "month"),
        (t.rlike(month_re), at(year(month_re, 2), number[pick(month_re, 1)], 15), "month"),
        (t.rlike(in_year_re), at(pick(in_year_re, 1).cast("int"), F.lit(7), 1), "year"),
        (t.rlike(year_re), at(pick(year_re, 1).cast("int"), F.lit(7), 1), "year"),
    ]):
        instant, grain = F.when(match, value).otherwise(instant), F.when(match, g).otherwise(grain)
    return instant, grain


def between_points(text: Column, clock: Column) -> tuple[Column, Column, Column]:
    """(start, end, grain) of "between A and B"; B's year serves A; equal points give nulls."""
    split = r"(?i)\bbetween\b(.+?)\band\b(.+)$"
    left, right = F.regexp_extract(text, split, 1), F.regexp_extract(text, split, 2)
    right_at, right_grain = calendar_point(right, clock)
    left_at, left_grain = calendar_point(left, F.coalesce(right_at, clock))
    ok = right_at.isNotNull() & left_at.isNotNull() & (left_at != right_at)
    grain = F.when(left_grain == right_grain, left_grain).otherwise("unknown")
    return F.when(ok, F.least(left_at, right_at)), F.when(ok, F.greatest(left_at, right_at)), F.when(ok, grain)
