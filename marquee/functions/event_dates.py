"""Dates as listing pages write them; what can't be read is null, and today is an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.dates import year_inferred
from marquee.functions.text import collapse

# fixed values: month names by their first three letters
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY, _MONTH = r"(\d{1,2})(?:st|nd|rd|th)?", r"([A-Za-z]{3,})"


def month_number(x: Column) -> Column:
    """1 to 12 by the first three letters."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(x, 1, 3))), F.lit(0)).cast("int")


def day_number(x: Column) -> Column:
    """The day of a text such as 15th; 1 to 31."""
    n = F.regexp_extract(x, _DAY, 1).try_cast("int")
    return F.when(n.between(1, 31), n)


# fixed values: a range of times, a time that ends a text, and a time with am or pm
_SPAN, _LAST, _HALF = r"(\d{1,2}):(\d{2})\s*-\s*\d{1,2}:\d{2}", r"(\d{1,2}):(\d{2})\s*$", r"(?i)(\d{1,2}):?(\d{2})?\s*(am|pm)(?![a-z])"


def clock(x: Column) -> Column:
    """Minutes of the day: a range's start, a 24-hour time at the end, or a time with am or pm."""
    part = lambda p, k: F.regexp_extract(x, p, k).try_cast("int")
    day = lambda h, m: F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)
    span, last, half = _SPAN, _LAST, _HALF
    h, m = part(half, 1), F.coalesce(part(half, 2), F.lit(0))
    pm = F.lower(F.regexp_extract(x, half, 3)) == "pm"
    twelve = F.when(h.between(1, 12), day(h % 12 + F.when(pm, 12).otherwise(0), m))
    return F.coalesce(day(part(span, 1), part(span, 2)), day(part(last, 1), part(last, 2)), twelve)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d))


def relative_day(x: Column, today: dt.date) -> Column:
    word = F.lower(F.trim(x))
    return F.when(word == "today", F.lit(today)).when(word == "tomorrow", F.lit(today + dt.timedelta(days=1)))


def dotted_day(x: Column) -> Column:
    """Such as Wed.13.Aug.25."""
    p = r"(\d{1,2})\.([A-Za-z]{3})[A-Za-z]*\.(\d{2})(?!\d)"
    return _date(F.regexp_extract(x, p, 3).try_cast("int") + 2000, month_number(F.regexp_extract(x, p, 2)), F.regexp_extract(x, p, 1).try_cast("int"))


def full_day(x: Column) -> Column:
    """Such as Tuesday 12 Aug 2025."""
    p = rf"{_DAY}\s+{_MONTH},?\s+(\d{{4}})"
    return _date(F.regexp_extract(x, p, 3).try_cast("int"), month_number(F.regexp_extract(x, p, 2)), F.regexp_extract(x, p, 1).try_cast("int"))


def month_first_day(x: Column) -> Column:
    """Such as March 15, 2024."""
    p = rf"{_MONTH}\.?\s+{_DAY},?\s+(\d{{4}})"
    return _date(F.regexp_extract(x, p, 3).try_cast("int"), month_number(F.regexp_extract(x, p, 1)), F.regexp_extract(x, p, 2).try_cast("int"))


def short_day(x: Column, today: dt.date) -> Column:
    """Such as Thu, 28 Aug or Friday 15th August: this year's, or next year's when past."""
    p = rf"{_DAY}\s+{_MONTH}"
    return year_inferred(month_number(F.regexp_extract(x, p, 2)), F.regexp_extract(x, p, 1).try_cast("int"), today)


def numeric_day(x: Column, dayfirst: bool = False) -> Column:
    """ISO dates, and dates with slashes or hyphens, month first unless ``dayfirst``."""
    p = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    a, b, y = (F.regexp_extract(x, p, k).try_cast("int") for k in (1, 2, 3))
    return F.coalesce(F.try_to_date(F.regexp_extract(x, r"^\s*(\d{4}-\d{2}-\d{2})", 1)), _date(y, b, a) if dayfirst else _date(y, a, b))


def parse_day(x: Column, today: dt.date, dayfirst: bool = False) -> Column:
    x = collapse(x)
    return F.coalesce(relative_day(x, today), numeric_day(x, dayfirst), dotted_day(x), full_day(x), short_day(x, today))


def at_minute(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_interval(mins=minutes)


def parse_start(day: Column, time: Column, today: dt.date, hour: int = 19, dayfirst: bool = False) -> Column:
    """Start of an event: its day, and the time of either text, else ``hour``."""
    return at_minute(parse_day(day, today, dayfirst), F.coalesce(clock(time), clock(day), F.lit(hour * 60)))


#: What stands for a date that can't be read, where a site's rule wants one.
SENTINEL = dt.datetime(2099, 12, 31, 23, 59, 59)
#: Sites' rules (fixed values): the hour of dates without a time, the time of dates whose row has none, and what
#: stands for a date that can't be read: the current time, the sentinel, or nothing (null).
SITES = {
    "lanes": (22, None, None),
    "croft": (19, None, "now"),
    "thekla": (12, None, None),
    "fleece": (12, None, "sentinel"),
    "strange-brew": (19, None, "sentinel"),
    "louisiana": (19, "7:30pm", "now"),
    "electric": (19, "7:00pm", "now"),
    "rough-trade": (19, None, "sentinel"),
}


def site_start(site: str, text: Column, time: Column, as_of: dt.datetime) -> Column:
    """Start of an event as a site writes it: day and time of ``text``, the time of ``time`` first; see ``SITES``.

    "Tomorrow" may stand anywhere in the text. A blank or null text is a date that can't be read.
    """
    hour, given, otherwise = SITES[site]
    today = as_of.date()
    soon = F.when(F.lower(text).contains("tomorrow"), F.lit(today + dt.timedelta(days=1)))
    day = F.coalesce(soon, parse_day(text, today))
    minutes = F.coalesce(clock(time), clock(text), *([clock(F.lit(given))] if given else []), F.lit(hour * 60))
    fallback = {"now": as_of, "sentinel": SENTINEL}.get(otherwise)
    start = at_minute(day, minutes)
    return start if fallback is None else F.coalesce(start, F.lit(fallback).cast("timestamp_ntz"))


def group_range(group: Column, span: Column, today: dt.date) -> Column:
    """struct(start, end) of a day's heading and a range of times; an end before the start is the next day's."""
    day, start, end = parse_day(group, today), clock(span), clock(F.regexp_extract(span, r"(\d{1,2}:\d{2})\s*$", 1))
    return F.struct(at_minute(day, start).alias("start"), at_minute(day, F.when(end < start, end + 1440).otherwise(end)).alias("end"))


def hours_between(a: Column, b: Column) -> Column:
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    return F.abs(ms(a) - ms(b)) / 3_600_000


def day_buckets(ts: Column, hours: int) -> Column:
    """Four-hour buckets within ``hours`` of a time: equal buckets are the keys of a band join."""
    second = F.unix_seconds(ts.cast("timestamp"))
    return F.array_distinct(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.floor((second + i * hours * 1800) / 14_400)))


def displayed(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy 'at' hh:mm a")
