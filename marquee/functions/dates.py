"""Date functions; the reference time and time zone are always arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(x: Column) -> Column:
    """Timestamp, or null where the text is none."""
    return F.try_to_timestamp(x)


def parse_ical(x: Column) -> Column:
    """A calendar's day or second, else any ISO form; null where the text is none."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmmss", "yyyyMMdd")], F.try_to_timestamp(x))


def parse_time(x: Column) -> Column:
    """Minutes of the day of a 12- or 24-hour time; null where out of range."""
    part = lambda k: F.regexp_extract(x, r"(?i)^\s*(\d{1,2}):(\d{2})\s*(am|pm)?\s*$", k)
    h, m, half = F.try_to_number(part(1), F.lit("99")).cast("int"), F.try_to_number(part(2), F.lit("99")).cast("int"), F.lower(part(3))
    ok = F.when(half == "", h.between(0, 23)).otherwise(h.between(1, 12)) & m.between(0, 59)
    hour = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    return F.when(ok, hour * 60 + m)


# fixed values: forms of time zones in a text, first to last
ZONES = (r"(?i)(?:UTC|GMT)(?:[+-]\d{1,2}(?::\d{2})?)?", r"(?i)(?:EST|PST|MST|CST|EDT|PDT|MDT|CDT)(?![A-Za-z0-9_])", r"[A-Z]{3,4}(?![A-Za-z0-9_])")


def time_zone(x: Column) -> Column:
    """The first time zone that a text names, in capitals; null if none."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(x, f"(?<![A-Za-z0-9_])(?:{p})", 0), F.lit("")) for p in ZONES]))


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """The day of a UTC timestamp in a time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def same_day(a: Column, b: Column, zone: str = "UTC") -> Column:
    """Two timestamps are on one day; false where one is null."""
    return F.coalesce(local_day(a, zone) == local_day(b, zone), F.lit(False))


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def is_future(ts: Column, as_of: dt.datetime) -> Column:
    return ts > F.lit(as_of)


def is_reasonable(ts: Column, as_of: dt.datetime) -> Column:
    """At most 365 days back and 730 ahead."""
    return ts.between(F.lit(as_of - dt.timedelta(days=365)), F.lit(as_of + dt.timedelta(days=730)))


def round_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts + F.expr("INTERVAL 30 MINUTES"))


def named_range(option: str, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of today, tomorrow, this-week, this-month or all."""
    day = dt.timedelta(days=1)
    if option == "today":
        return today, today
    if option == "tomorrow":
        return today + day, today + day
    if option == "this-week":
        left = 6 - today.weekday()
        return today, today + day * (left or 6)
    if option == "this-month":
        return today, (today.replace(day=28) + 4 * day).replace(day=1) - day
    return None, None


def option_of(first: dt.date | None, last: dt.date | None, today: dt.date) -> str:
    """The named range that has these days, else ``all``; the first that fits."""
    return next((o for o in ("today", "tomorrow", "this-week", "this-month") if named_range(o, today) == (first, last)), "all")


def ordinal_day(ts: Column) -> Column:
    """Such as ``Tue 12th August 2025``."""
    d = F.dayofmonth(ts)
    suffix = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(ts, "EEE "), d.cast("string"), suffix, F.date_format(ts, " MMMM yyyy"))


def year_inferred(month: Column, day: Column, as_of: dt.date) -> Column:
    """The date of a month and day without year: this year's, or next year's when past."""
    this = F.try_to_date(F.format_string("%04d-%02d-%02d", F.lit(as_of.year), month, day))
    following = F.try_to_date(F.format_string("%04d-%02d-%02d", F.lit(as_of.year + 1), month, day))
    return F.when(this < F.lit(as_of), following).otherwise(this)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Two ranges meet; a missing end is the start."""
    return (s1 <= F.coalesce(e2, s2)) & (s2 <= F.coalesce(e1, s1))


def is_happening(start: Column, end: Column, as_of: dt.datetime) -> Column:
    return F.lit(as_of).between(start, F.coalesce(end, start + F.expr("INTERVAL 3 HOURS")))
