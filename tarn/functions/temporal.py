"""Time: strict texts to instants in UTC, intervals with open ends, local times with fixed offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def strict_utc(text: Column) -> Column:
    """The instant of ``yyyy-MM-ddTHH:mm:ssZ``; null for any other form and for days that don't exist."""
    return F.when(text.rlike(STRICT), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def rfc3339_utc(text: Column) -> Column:
    """The instant of an RFC 3339 text in UTC (``Z`` or ``+00:00``), with a fraction or without; else null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|\+00:00)$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def strict_date(text: Column) -> Column:
    """The day of ``yyyy-MM-dd``; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def local_to_utc(date: Column, time: Column, offset_minutes: Column) -> Column:
    """The instant of a local day and time whose zone is so many minutes ahead of UTC; null if any is malformed or null."""
    shaped = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & time.rlike(r"^\d{2}:\d{2}:\d{2}$")
    local = F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(shaped, local - F.make_dt_interval(mins=offset_minutes))


def microsecond_text(instant: Column) -> Column:
    """An instant in UTC with six decimals of a second."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _endpoint(text: Column) -> Column:
    return F.when(text.isin("", "..", "…"), F.lit(None)).otherwise(
        F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date").cast("timestamp"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?$"), F.try_to_timestamp(text))
    )


def temporal_interval(text: Column) -> Column:
    """struct<start, end, problem> of ``a/b``, ``../b``, ``a/..``: either end may be open.

    problem: null, ``invalid_temporal_coverage`` (no two parts) or ``invalid_temporal_endpoint`` (an end that is no time).
    """
    parts = F.split(text, "/", -1)
    start, end = _endpoint(parts[0]), _endpoint(F.try_element_at(parts, F.lit(2)))
    none = F.coalesce(text, F.lit("")) == ""
    two = F.size(parts) == 2
    bad = lambda given, got: ~given.isin("", "..", "…") & got.isNull()
    problem = F.when(none, F.lit(None)).when(~two, F.lit("invalid_temporal_coverage")).when(bad(parts[0], start) | bad(F.try_element_at(parts, F.lit(2)), end), F.lit("invalid_temporal_endpoint"))
    return F.struct(F.when(~none & two, start).alias("start"), F.when(~none & two, end).alias("end"), problem.alias("problem"))


def intersection(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """struct<start, end, outside>: the later start and the earlier end, nulls being open; both null where they pass each other."""
    s, e = F.greatest(start, other_start), F.least(end, other_end)
    outside = F.coalesce(s > e, F.lit(False))
    return F.struct(F.when(~outside, s).alias("start"), F.when(~outside, e).alias("end"), outside.alias("outside"))
