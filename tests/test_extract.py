import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import event_dates, extract
from marquee.operators import sources
from marquee.queries import QUERIES
from marquee.sources import files, structured

TODAY = dt.date(2025, 8, 12)


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_days(spark):
    texts = {"Today": (2025, 8, 12), "tomorrow ": (2025, 8, 13), "Wed.13.Aug.25": (2025, 8, 13), "Tuesday 12 Aug 2025": (2025, 8, 12), "Thu, 28 Aug, 7:30 pm": (2025, 8, 28), "Monday 11th August": (2026, 8, 11), "2025-12-01T20:00": (2025, 12, 1), "08/20/2025": (2025, 8, 20)}
    got = apply(spark, lambda x: event_dates.parse_day(x, TODAY), [*texts, "no date", "32 Foo", "", None])
    assert got == [*(dt.date(*d) for d in texts.values()), None, None, None, None]
    assert apply(spark, lambda x: event_dates.numeric_day(x, dayfirst=True), ["20/08/2025"]) == [dt.date(2025, 8, 20)]


def test_clock(spark):
    texts = {"13:00 - 14:45": 780, "19:30": 1170, "Doors: 07:00 pm": 1140, "7pm": 1140, "12:15 am": 15, "25:00": None, "13 pm": None, "12 Amsterdam": None, "": None}
    assert apply(spark, event_dates.clock, [*texts, None]) == [*texts.values(), None]


def test_starts_and_ranges(spark):
    row = spark.sql("SELECT 'Friday 15th August' d, '22:30 - 03:00' t, CAST(NULL AS STRING) n")
    d, t, n = F.col("d"), F.col("t"), F.col("n")
    got = row.select(event_dates.parse_start(d, t, TODAY), event_dates.parse_start(d, n, TODAY), event_dates.group_range(d, t, TODAY)).first()
    assert got[0] == dt.datetime(2025, 8, 15, 22, 30) and got[1] == dt.datetime(2025, 8, 15, 19)
    assert tuple(got[2]) == (dt.datetime(2025, 8, 15, 22, 30), dt.datetime(2025, 8, 16, 3))


def test_near_times_share_a_bucket(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2025-08-12 11:59:00' a, TIMESTAMP_NTZ '2025-08-12 12:30:00' b")
    assert row.select(F.arrays_overlap(event_dates.day_buckets(F.col("a"), 2), event_dates.day_buckets(F.col("b"), 2))).first()[0]
    assert round(row.select(event_dates.hours_between(F.col("a"), F.col("b"))).first()[0], 4) == 0.5167


def test_text_fields(spark):
    assert apply(spark, extract.artists, ["A featuring B & C, D (x, y) and E", "", None]) == [["A", "B", "C", "D (x, y)", "E"], [], None]
    assert [tuple(a) for a in apply(spark, extract.address, ["1 High St", "1 High St, Bristol", "Flat 2, 1 High St, Bristol, UK"])] == [("1 High St", None, None), ("1 High St", "Bristol", None), ("Flat 2, 1 High St", "Bristol", "UK")]
    assert apply(spark, extract.genres, ["Indie rock and jazz", "none"]) == [["Rock", "Indie", "Indie Rock", "Jazz"], []]
    assert apply(spark, extract.main_artist, ["Blue + Red feat Green", "Solo"]) == ["blue", "solo"]
    assert apply(spark, extract.searchable, ["The sound of the city"]) == ["sound city"]
    assert apply(spark, extract.venue_label, ["The  Fleece"]) == ["Fleece"]


def test_transforms(spark):
    assert apply(spark, lambda x: extract.transformed(x, "regex", {"pattern": "b+", "replacement": "-", "flags": "i"}), ["aBBc"]) == ["a-c"]
    assert apply(spark, lambda x: extract.transformed(x, "extract-text", {"pattern": r"(\d+)"}), ["ab12", "ab"]) == ["12", "ab"]
    assert apply(spark, lambda x: extract.transformed(x, "unknown"), ["a"]) == ["a"]
    assert apply(spark, lambda x: extract.transformed(F.array(x, F.lit(None)), "uppercase", is_array=True), ["a"]) == [["A"]]
    assert apply(spark, lambda x: extract.transformed(x, "time-range-start"), ["19:00 - 21:00", "x"]) == ["19:00", None]


PAGE = """<html><head><meta property="og:title" content="Old"><meta content="Gig" property="og:title">
<script type="application/ld+json">{"@type": "MusicEvent", "name": "Jazz", "startDate": "2025-08-20", "location": {"name": "Hall"}}</script>
<script type="application/ld+json">{bad</script></head><body>
<div itemscope itemtype="http://schema.org/Event"><h1 itemprop="name">Rock <b>Night</b></h1><time itemprop="startDate" datetime="2025-09-01">1 Sep</time><img itemprop="image" src="a.png"></div>
<li>One<i>x</i></li><li></li></body></html>"""


def test_structured_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id long, html string")
    got = sorted(tuple(r) for r in structured.structured_events(pages).select("page_id", "kind", "title", "date", "location").collect())
    assert got == [(1, "json-ld", "Jazz", "2025-08-20", "Hall"), (1, "microdata", "Rock Night", "2025-09-01", None), (1, "open-graph", "Gig", None, None)]
    fields = {"name": {"pattern": "^([^<]+)", "required": True, "transform": "uppercase"}, "mark": {"pattern": "<i>(.*?)</i>", "fallback": "none"}, "all": {"pattern": "<i>(.*?)</i>", "multiple": True}}
    rows = structured.declared_rows(pages, r"(?s)<li>(.*?)</li>", fields).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "ONE", "x", ["x"])]


def test_feeds(spark):
    docs = spark.createDataFrame([("text/calendar", "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\nDTSTART:20240101\nEND:VEVENT"), (None, ' [{"title": "B", "date": "2024-01-02"}]'), (None, "<rss><item><title>C</title><pubDate>x</pubDate></item></rss>"), (None, "plain")], "content_type string, content string")
    assert sorted((r["format"], r["title"]) for r in structured.feed_events(docs).collect()) == [("ical", "A"), ("json", "B"), ("rss", "C")]
    feed = spark.createDataFrame([('{"version": "1", "items": [{"summary": "S", "url": "u"}, {"url": "v"}]}',)], "content string")
    assert [tuple(r) for r in structured.json_feed(feed).collect()] == [("S", "u", None)]


def test_robots(spark):
    urls = spark.createDataFrame([("h", "/a/1"), ("h", "/b"), ("k", "/a/1"), (None, "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a"), ("k", "")], "host string, disallow string")
    assert sorted(map(tuple, structured.allowed_urls(urls, rules).collect()), key=repr) == [("h", "/b"), ("k", "/a/1"), (None, "/a")]


def test_files(spark, tmp_path):
    (tmp_path / "Venue-A.normalized.json").write_text('{"gigs": [\n{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "bad.normalized.json").write_text("{no")
    (tmp_path / "other.json").write_text('{"gigs": [{"id": "3"}]}')
    assert sorted(map(tuple, files.read_snapshots(spark, str(tmp_path), "id: string").collect())) == [("venue-a", "1"), ("venue-a", "2")]
    log = str(tmp_path / "log")
    files.append_log(spark.sql("SELECT TIMESTAMP '2025-08-01 10:00:00' timestamp, 1 n UNION ALL SELECT TIMESTAMP '2025-06-01 10:00:00', 2"), log)
    assert [r["n"] for r in files.read_log(spark, log, "timestamp timestamp, n int", first=dt.date(2025, 7, 1)).collect()] == [1]
    assert files.drop_old_days(spark, log, TODAY) == ["2025-06-01"]
    assert files.read_log(spark, log, "timestamp timestamp, n int").count() == 1
    snap = str(tmp_path / "snap")
    files.write_snapshot(spark.sql("SELECT 'a' source, 1 n UNION ALL SELECT 'b', 2"), snap)
    files.write_snapshot(spark.sql("SELECT 'a' source, 3 n"), snap)
    assert sorted((r["source"], r["n"]) for r in spark.read.json(snap).collect()) == [("a", 3), ("b", 2)]


def test_jobs(spark):
    jobs = spark.sql("SELECT * FROM VALUES ('error', TIMESTAMP '2025-08-12'), ('running', TIMESTAMP '2025-08-11 23:00:00'), ('idle', TIMESTAMP '2025-08-10'), ('idle', NULL) AS t(status, last_run)")
    assert tuple(sources.job_summary(jobs, F.lit(dt.datetime(2025, 8, 12)).cast("timestamp")).first()) == (4, 1, 1, 1, 1)
    for states, want in ((["healthy", "degraded"], "healthy"), (["degraded", "degraded"], "degraded"), (["failed"] * 3, "critical")):
        assert sources.overall_health(spark.createDataFrame([(s,) for s in states], "state string")).first()[0] == want


def test_document_all_genres(spark, tmp_path):
    texts = ["House and RAP", "folk rock", "drum and bass, dnb", "nothing", "orchestra, hip-hop & r&b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["genres"] for r in QUERIES["document_all_genres"](spark, str(tmp_path)).collect()}
    want = {i: ",".join(dict.fromkeys(v for k, v in extract.GENRES.items() if k in (t or "").lower())) for i, t in enumerate(texts)}
    assert got == want and want[0] == "House,Hip Hop"
