"""Exact values of parsers and likeness on literal texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import dates, event_dates, extract, text
from marquee.functions.similarity import jaro_winkler
from marquee.sources import feeds


def _of(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_times(spark):
    assert _of(spark, ["12:00 AM", "8:60 PM", "25:00", "19:30", "7:30 pm", "noon"], dates.parse_time) == [0, None, None, 1170, 1170, None]


def test_prices(spark):
    got = [tuple(r) for r in _of(spark, ["$15-30", "10-15 EUR", "Price: £25.99", "Free"], text.price)]
    assert got == [(15.0, 30.0, "USD"), (10.0, 15.0, "EUR"), (25.99, 25.99, "GBP"), (0.0, 0.0, None)]


def test_days(spark):
    today, x = dt.date(2025, 8, 12), ["Today", "Wed.13.Aug.25", "Thu, 28 Aug, 7:30 pm", "Monday 11th August 13:00 - 14:45", "08/20/2025", "soon"]
    assert _of(spark, x, lambda c: event_dates.parse_day(c, today)) == [dt.date(2025, 8, 12), dt.date(2025, 8, 13), dt.date(2025, 8, 28), dt.date(2026, 8, 11), dt.date(2025, 8, 20), None]
    assert _of(spark, x, event_dates.clock) == [None, None, 1170, 780, None, None]
    assert _of(spark, ["March 15, 2024 8:00 PM", "Sept. 1st 2025"], event_dates.month_first_day) == [dt.date(2024, 3, 15), dt.date(2025, 9, 1)]


def test_titles(spark):
    assert _of(spark, ["Blue feat Red & Green"], extract.artists) == [["Blue", "Red", "Green"]]
    assert _of(spark, ["Blue feat Red & Green"], extract.main_artist) == ["blue feat red"] and _of(spark, ["Blue feat Red & Green"], extract.searchable) == ["blue feat red green"]


def test_likeness(spark):
    pairs = [("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("abc", "", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    assert all(abs(r.s - r.got) < 1e-6 for r in df.select("s", jaro_winkler(F.col("a"), F.col("b")).alias("got")).collect())


def test_feeds(spark):
    rss = "<rss><channel><item><title>Jazz Night</title><link>http://x.example/1</link><pubDate>Mon, 15 Jan 2024 20:00:00 GMT</pubDate><category>Jazz</category></item><item><title>No date</title></item></channel></rss>"
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;TZID=Europe/London:20240115T200000\r\nSUMMARY:Rock\\, loud and\r\n  long\r\nLOCATION:Hall\r\nEND:VEVENT\r\nEND:VCALENDAR"
    body = '{"events": [{"name": "A", "date_start": "2024-01-15", "venue": "Hall"}, {"title": "B", "start_date": "2024-02-01"}, {"title": "no date"}]}'
    doc = lambda x: spark.createDataFrame([(x,)], "content string")
    assert [r.title for r in feeds.rss(doc(rss)).collect()] == ["Jazz Night"]
    assert [(r.uid, r.title, r.location) for r in feeds.ical(doc(ics)).collect()] == [("1", "Rock, loud and long", "Hall")]
    assert [(r.title, r.location) for r in feeds.json_events(doc(body)).collect()] == [("A", "Hall"), ("B", None)]
