"""Feed files as a source and a stream, catalogue versions, plugin folders, bulk inserts, patches, pages."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from marquee.functions.extract import transformed
from marquee.operators import changes
from marquee.operators.quality import repeated_keys
from marquee.sources import feed_source, plugins, structured, versions

NOW = dt.datetime(2025, 1, 1)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "feeds"
    (at / "more").mkdir(parents=True)
    (at / "Hall.rss").write_text("<rss><item><title>A</title><pubDate>Mon, 15 Jan 2024</pubDate></item></rss>")
    (at / "more/club.ics").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:B\nDTSTART:20240115T200000Z\nEND:VEVENT\nEND:VCALENDAR")
    (at / "bar.json").write_text('[{"name": "C", "start_date": "2024-02-01"}]')
    (at / "_hidden.json").write_text("[]")
    (at / "notes.txt").write_bytes(b"\xff\xfe")
    for k, name in enumerate(("Hall.rss", "more/club.ics", "bar.json", "notes.txt")):
        os.utime(at / name, (1_700_000_000 + k, 1_700_000_000 + k))
    return at


def test_feed_files(spark, folder):
    feed_source.register(spark)
    rows = spark.read.format("feed_files").option("bytes", 10).load(str(folder))
    assert sorted((r.source, r.kind or "") for r in rows.collect()) == [("bar", "json"), ("club", "ical"), ("hall", "rss"), ("notes", "")]
    assert rows.rdd.getNumPartitions() == 4
    events = structured.feed_events(rows).collect()
    assert sorted((r.format, r.title) for r in events) == [("ical", "B"), ("json", "C"), ("rss", "A")]
    some = rows.where((F.col("kind") == "rss") & F.col("source").isin("hall", "club"))
    assert [r.source for r in some.collect()] == ["hall"] and some.rdd.getNumPartitions() == 1
    assert "isin" not in some._jdf.queryExecution().executedPlan().toString().lower().split("batchscan")[0]  # nothing is left to filter above the scan
    late = rows.where(F.col("modified") >= dt.datetime.fromtimestamp(1_700_000_002))
    assert sorted(r.source for r in late.collect()) == ["bar", "notes"]
    assert spark.read.format("feed_files").load(str(folder / "none")).count() == 0


def test_feed_files_as_a_stream(spark, folder, tmp_path):
    feed_source.register(spark)
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("feed_files").load(str(folder)).select("source", "kind")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.source for r in spark.read.parquet(out).collect())

    assert run() == ["bar", "club", "hall", "notes"]
    (folder / "new.html").write_text("<h1>x</h1>")
    assert run() == ["bar", "club", "hall", "new", "notes"] == run()


def test_catalogue_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda n: spark.range(n).selectExpr("id", "'s' source", "timestamp_ntz '2025-01-01 00:00:00' date_start", "timestamp_ntz '2025-01-01 00:00:00' updated_at")
    assert versions.current(path) is None
    with pytest.raises(ValueError):
        versions.Catalogue(spark, path, NOW).table("rows")
    versions.write_version(versions.catalogue_tables(rows(3), NOW), path, NOW)
    reader = versions.Catalogue(spark, path, NOW)
    pinned = reader.table("rows")
    versions.write_version(versions.catalogue_tables(rows(5), NOW), path, NOW)
    rows(9).write.parquet(f"{path}/v-00000003-broken/rows")  # a writer that failed before it moved the pointer
    assert pinned.count() == reader.table("rows").count() == reader.table("metadata").first().total == 3
    assert not reader.refresh(NOW + dt.timedelta(minutes=4)) and reader.table("rows").count() == 3
    assert reader.refresh(NOW + dt.timedelta(minutes=6)) and reader.table("rows").count() == reader.table("metadata").first().total == 5
    versions.write_version(versions.catalogue_tables(rows(6), NOW), path, NOW)
    assert versions.Catalogue(spark, path, NOW).table("rows").count() == 6 and reader.table("rows").count() == 5
    assert not os.path.exists(f"{path}/{os.path.basename('v-00000001')}") and len([f for f in os.listdir(path) if f.startswith("v-00000001")]) == 0


def test_plugin_folder(spark, tmp_path):
    (tmp_path / "hall.py").write_text("fetch = lambda spark: spark.range(2)\ndef normalise(rows):\n    return rows.selectExpr('id', \"cast(null as string) venue\")\n")
    (tmp_path / "_part.py").write_text("x = 1")
    assert plugins.load_folder(str(tmp_path)) == ["hall"]
    assert [(r.id, r.venue, r.source) for r in plugins.rows_of(spark, "hall", "Hall").collect()] == [(0, "Hall", "hall"), (1, "Hall", "hall")]
    (tmp_path / "bad.py").write_text("fetch = 3")
    with pytest.raises(TypeError):
        plugins.load_folder(str(tmp_path))
    (tmp_path / "a.json").write_text('{"site": {"name": "A"}}')
    (tmp_path / "b.json").write_text("[" * 50_000)
    got = plugins.read_configs(spark, str(tmp_path / "*.json")).orderBy("path").collect()
    assert [(r.name, r.errors[0]) for r in got] == [("A", "missing workflow"), (None, "not JSON")]


def test_inserts_patches_and_pages(spark):
    base = spark.createDataFrame([(1, "a", NOW), (2, "b", NOW)], "id long, v string, updated_at timestamp_ntz")
    batch = spark.createDataFrame([(2, "x", NOW), (3, "c", NOW), (3, "c", NOW), (None, "n", NOW), (None, "m", NOW)], base.schema)
    whole, refused = changes.insert_new(base, batch)
    assert sorted((r.id or 0) for r in whole.collect()) == [0, 1, 2, 3] and sorted((r.id or 0) for r in refused.collect()) == [0, 2, 3]
    later = dt.datetime(2026, 1, 1)
    change = spark.createDataFrame([(1, None, dt.datetime(2020, 1, 1))], base.schema)
    assert sorted(map(tuple, changes.patch(base, change, as_of=F.lit(later).cast("timestamp_ntz")).collect())) == [(1, "a", later), (2, "b", NOW)]
    assert sorted(map(tuple, changes.patch(base, change).collect())) == [(1, "a", dt.datetime(2020, 1, 1)), (2, "b", NOW)]
    pages = spark.createDataFrame([(2, [(3,)], 9), (1, [(1,), (2,)], 3)], "page int, data array<struct<id: int>>, total int")
    rows, total = changes.from_pages(pages)
    assert [(r.page, r.place, r.id) for r in rows.orderBy("page", "place").collect()] == [(1, 0, 1), (1, 1, 2), (2, 0, 3)] and total.first().total == 3
    groups = base.groupBy(F.lit(1).alias("g")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    assert sorted(map(tuple, changes.flattened(groups).collect())) == [(1, "a"), (2, "b")]


def test_small_rules(spark):
    rows = spark.createDataFrame([("Tomorrow 21:30", None), ("come TOMORROW", NOW), ("Friday", NOW), (None, NOW)], "date_text string, date_start timestamp_ntz")
    got = [r.date_start for r in plugins.late_tomorrow(rows, NOW).collect()]
    assert got == [dt.datetime(2025, 1, 2, 21, 30), dt.datetime(2025, 1, 2, 19), NOW, NOW]
    assert plugins.config_hash('{ "b": 1.0, "a": ["é", 2.5] }') == hashlib.sha256('{"b":1,"a":["é",2.5]}'.encode()).hexdigest()
    x = spark.createDataFrame([("03.02.2025",), ("soon",)], "x string").select(transformed(F.col("x"), "date", {"format": "dd.MM.yyyy"}))
    assert [r[0] for r in x.collect()] == ["2025-02-03T00:00:00", None]
    keys = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "id long")
    assert sorted(map(tuple, repeated_keys(keys).collect()), key=repr) == [(1, 2), (None, 2)]
