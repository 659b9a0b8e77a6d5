"""Other scalar functions: F24-F33 and P8, P9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .common import strip


def normalise_tags(tags: Column, max_chars: int | None = None) -> Column:
    """stripped, cut where a length is given, no empties, first of duplicates."""
    cut = F.transform(tags, lambda t: strip(t) if max_chars is None else F.substring(strip(t), 1, max_chars))
    return F.array_distinct(F.filter(cut, lambda t: t.isNotNull() & (t != "")))


def inactivity_score(since_last: Column, span: Column, age: Column, active_days: Column,
                     commits: Column, recent: Column) -> Column:
    """(days since last / mean gap) x (1 - recent share), two decimals.

    `since_last`, `span` and `age` count days from the last commit to now, from the
    first to the last commit and from the first commit to now; callers decide
    whether a day is a calendar day or 24 elapsed hours.
    """
    gap = F.greatest(span, F.lit(0)) / F.greatest(active_days - 1, F.lit(1))
    mean_gap = F.greatest(gap, F.lit(1.0))
    per_day = commits / F.greatest(age, F.lit(1))
    expected = F.greatest(per_day * F.lit(dims.INACTIVITY_WINDOW_DAYS), F.lit(1.0))
    recent_ratio = F.least(recent / expected, F.lit(1.0))
    return F.bround((since_last / mean_gap) * (F.lit(1.0) - recent_ratio), 2)


def clamp(score: Column) -> Column:
    """F26."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def iso_parse(raw: Column) -> Column:
    """ISO time with offset to an instant, null when it cannot be read."""
    ok = raw.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?)?$")
    return F.when(ok, F.try_to_timestamp(raw))


def day_of(raw: Column) -> Column:
    """the author's local date, whatever the offset."""
    return F.substring(raw, 1, 10).try_cast("date")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed days between two timestamps, rounded down."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def duration_days(start: Column, end: Column, as_of: Column) -> Column:
    """fractional days from start to end, or to the clock while it runs."""
    micros = F.unix_micros(F.coalesce(end, as_of).cast("timestamp")) - F.unix_micros(
        start.cast("timestamp")
    )
    return micros / F.lit(86_400_000_000.0)


def json_list(text: Column) -> Column:
    """JSON array of strings, empty when missing or broken."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def score_class(score: Column) -> Column:
    """F32."""
    return F.when(score >= 70, "high").when(score >= 40, "mid").otherwise("low")


def requirement_name(line: Column) -> Column:
    """F33."""
    return F.regexp_extract(line, dims.REQUIREMENT_PATTERN, 1)


def requirement_version(line: Column) -> Column:
    version = strip(F.regexp_extract(line, dims.REQUIREMENT_PATTERN, 2))
    return F.when(version != "", version)


def _like_literal(term: str) -> str:
    return "%" + term.strip() + "%"


def ilike_any(term: str, *columns: Column) -> Column:
    """SQL pattern search over several columns; % and _ keep their meaning."""
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(c.ilike(_like_literal(term)), F.lit(False)) for c in columns],
    )


def contains_any(term: str, *columns: Column) -> Column:
    """Plain substring search, nulls as ''."""
    needle = term.strip().lower()
    return reduce(
        lambda a, b: a | b,
        [F.lower(F.coalesce(c, F.lit(""))).contains(needle) for c in columns],
    )


def month_ends(as_of: str, years: int) -> Column:
    """array of the last days of years x 12 months, the clock's month last."""
    start = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -(years * 12 - 1))
    stop = F.trunc(F.lit(as_of).cast("date"), "month")
    months = F.sequence(start, stop, F.expr("interval 1 month"))
    return F.transform(months, F.last_day)
