import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates, hashing, text
from tests.plain_similarity import jaro, winkler


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (text.slug, {"The Amazing Concert!": "the-amazing-concert", "Rock & Roll": "rock-roll", "  Multiple   Spaces  ": "multiple-spaces", "Event 2024 v1.5": "event-2024-v15"}),
        (text.normal, {"Rock & Roll": "rock roll", "Rock and Roll": "rock & roll", "Café £5 – Bar": "café £5 – bar", "10th Ave.": "10th avenue", "a_b [c] x/y": "ab c xy", None: None, "Band-Name": "bandname", "st mary": "street mary", "live show": ""}),
        (text.normal_venue, {"The O2 Arena": "o2", "Sports Bar & Venue": "sports", "O'Malley's Pub": "omalleys", "Café del Mar": "café del mar"}),
        (text.normal_title, {"Band presents: Live Concert": "band", "Artist World Tour": "artist", "Album Release Party 2024": "release party 2024"}),
        (text.normal_city, {"New York City": "new york", "Kings County": "kings"}),
    ],
)
def test_text(spark, f, pairs):
    assert apply(spark, f, list(pairs)) == list(pairs.values())


def test_listing_id(spark):
    row = spark.sql("SELECT 'The Venue' v, 'Amazing Concert' t, '2024-01-15T20:00:00Z' d, 'Amsterdam' c")
    got = row.select(text.listing_id(*map(F.col, "vtdc"))).first()[0]
    assert got == "the-venue-amazing-concert-2024-01-15t200000z-amsterdam"


def test_price(spark):
    got = apply(spark, text.price, ["$15-30", "10-15 EUR", "Price: £25.99", "Free", "none"])
    assert [tuple(x) for x in got] == [(15, 30, "USD"), (10, 15, "EUR"), (25.99, 25.99, "GBP"), (0, 0, None), (None, None, None)]


def test_times_and_hashes(spark):
    assert apply(spark, dates.parse_time, ["12:00 AM", "8:60 PM", "25:00", "19:30"]) == [0, None, None, 1170]
    assert apply(spark, hashing.quick_hash, ["abc", ""]) == ["17862", "0"]
    assert apply(spark, hashing.is_hash, ["a" * 64, "g" * 64]) == [True, False]


def test_jaro():
    assert jaro("", "") == 1 and jaro("a", "") == 0 and round(jaro("martha", "marhta"), 3) == 0.944
    assert round(winkler("dixon", "dicksonx"), 3) == 0.813 and winkler("x" * 1000, "y" * 1000) == 0


def test_ranges():
    sunday, tuesday = dt.date(2025, 8, 17), dt.date(2025, 8, 12)
    assert dates.named_range("this-week", tuesday) == (tuesday, sunday)
    assert dates.named_range("this-week", sunday) == (sunday, dt.date(2025, 8, 23))
    assert dates.named_range("this-month", dt.date(2024, 2, 5))[1] == dt.date(2024, 2, 29)
