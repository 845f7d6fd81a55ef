"""Reporting periods: calendar placement, literals and keys, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = "0001-01-01T00:00:00/9999-12-31T00:00:00"
#: Inclusive day counts of the duration buckets.
BUCKETS = {"quarterly": (80, 100), "semi_annual": (170, 190), "nine_months": (260, 280), "annual": (350, 380)}


def quarter_of(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def span_days(start: Column, end: Column) -> Column:
    """Days between the dates; 0 where either is null."""
    return F.coalesce(F.datediff(end, start), F.lit(0))


def duration_type(start: Column, end: Column) -> Column:
    days = F.datediff(end, start) + 1
    out = None
    for name, (low, high) in BUCKETS.items():
        out = F.when(days.between(low, high), name) if out is None else out.when(days.between(low, high), name)
    return F.when(days.isNotNull(), out.otherwise("other"))


def calendar_quarter(start: Column, end: Column) -> Column:
    """Quarter, half, M9 or FY of a duration; quarter of an instant (null start); null for other spans."""
    kind = duration_type(start, end)
    return (
        F.when(start.isNull(), quarter_of(end)).when(kind == "quarterly", quarter_of(end))
        .when(kind == "semi_annual", F.when(F.month(end).between(4, 7), "H1").otherwise("H2"))
        .when(kind == "nine_months", "M9").when(kind == "annual", "FY")
    )


def calendar_key(start: Column, end: Column) -> Column:
    year, quarter = F.year(end).cast("string"), calendar_quarter(start, end)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return (
        F.when(start.isNull(), iso(end)).when(quarter == "FY", year)
        .when(quarter.isNotNull(), F.concat(year, quarter)).otherwise(F.concat(iso(start), F.lit("/"), iso(end)))
    )


def period_key(period_type: Column, start: Column, end: Column) -> Column:
    """What a reader names a period by: the date of an instant, start..end of a duration, forever."""
    iso = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("?"))
    return F.when(period_type == "instant", F.date_format(end, "yyyy-MM-dd")).when(period_type == "forever", "forever").when(period_type == "duration", F.concat(iso(start), F.lit(".."), iso(end)))


def period_wanted(key: Column, end: Column, wanted: list[str]) -> Column:
    """Whether a period was asked for by its key, by its end date or by the year of its end; no end matches by the key alone."""
    by_end = F.date_format(end, "yyyy-MM-dd").isin(wanted) | F.year(end).cast("string").isin(wanted)
    return F.coalesce(key.isin(wanted), F.lit(False)) | F.coalesce(by_end, F.lit(False))


def _endpoint(text: Column, exclusive: bool) -> Column:
    day = F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")
    return F.when(F.contains(text, F.lit("T")), F.date_sub(day, 1)).otherwise(day) if exclusive else day


def parse_interval(literal: Column) -> Column:
    """struct<period_type, start, end> of a period literal: ends with a time are exclusive, bare dates inclusive; null if unreadable."""
    text = F.trim(literal)
    sep = F.contains(text, F.lit("/"))
    first, second = F.split_part(text, F.lit("/"), F.lit(1)), F.substring_index(text, "/", -1)
    end = F.when(sep, _endpoint(second, True)).otherwise(_endpoint(first, True))
    start = F.when(sep, _endpoint(first, False))
    kind = F.when(text == FOREVER, "forever").when(sep, "duration").otherwise("instant")
    none = F.lit(None).cast("date")
    out = F.struct(kind.alias("period_type"), F.when(kind == "duration", start).alias("start"), F.when(kind != "forever", end).otherwise(none).alias("end"))
    return F.when((text == FOREVER) | (end.isNotNull() & (~sep | start.isNotNull())), out)


def format_interval(period_type: Column, start: Column, end: Column) -> Column:
    """The literal of a period, with exclusive ends at midnight."""
    at = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00"))
    return F.when(period_type == "forever", FOREVER).when(period_type == "instant", at(F.date_add(end, 1))).otherwise(F.concat(at(start), F.lit("/"), at(F.date_add(end, 1))))


def inclusive_date(stamp: Column) -> Column:
    """Date of a context end: exact midnight belongs to the day before; years outside 1900-2100 are null."""
    moment = F.try_to_timestamp(stamp)
    day = F.when(F.date_format(moment, "HH:mm:ss") == "00:00:00", F.when(F.contains(stamp, F.lit("T")), F.date_sub(moment.cast("date"), 1)).otherwise(moment.cast("date"))).otherwise(moment.cast("date"))
    return F.when(F.year(day).between(1900, 2100), day)


def edgar_date(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"^\s*(\d{8})\s*$", 1), "yyyyMMdd")


def fiscal_year_end(text: Column) -> Column:
    """--MM-DD as MMDD."""
    return F.when(text.rlike(r"^--\d{2}-\d{2}$"), F.regexp_replace(text, "-", "")).otherwise(text)


def fiscal_month(text: Column) -> Column:
    return F.try_to_number(F.regexp_extract(text, r"^--(\d{2})-\d{2}$", 1), F.lit("99")).cast("int")
