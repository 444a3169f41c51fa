"""Streams against batch versions: state in deltas, repeats, limits with expiry, restarts."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from marquee.plans.files import folders
from marquee.streaming.expiry import Limits, limited, without_repeats
from marquee.streaming.state import KeyedState, ingest_deltas

SCHEMA = "id string, hash string, updated_at timestamp"


def _day(n):
    return f"2024-01-{n:02d}T00:00:00Z"


def test_deltas_equal_a_sequential_version(spark, tmp_path):
    """Twelve batches over a restart a batch, late and equal rows, two compactions."""
    r, source, state = random.Random(1), tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    want: dict[str, tuple] = {}
    for batch in range(12):
        rows = [(f"k{r.randint(0, 30)}", f"h{r.randint(0, 3)}", r.randint(1, 20)) for _ in range(r.randint(1, 12))]
        newest: dict[str, tuple] = {}
        for i, h, d in rows:
            if i not in newest or (-d, h) < (-newest[i][1], newest[i][0]):
                newest[i] = (h, d)
        for i, (h, d) in newest.items():
            if i not in want:
                want[i] = (h, d, "new", d)
            elif d >= want[i][1]:
                want[i] = (h, d, "updated" if h != want[i][0] else "unchanged", want[i][3])
        (source / f"{batch:02d}.json").write_text("\n".join(json.dumps({"id": i, "hash": h, "updated_at": _day(d)}) for i, h, d in rows))
        ingest_deltas(spark, str(source), SCHEMA, state, str(tmp_path / "check"), every=5).awaitTermination()
    kept = KeyedState(spark, state, spark.createDataFrame([], SCHEMA).schema)
    got = {x.id: (x.hash, x.updated_at.day, x.change, x.first_seen.day) for x in kept.rows().collect()}
    assert got == want
    assert folders(f"{state}/base", marked=True) == ["version=4", "version=9"]
    assert folders(f"{state}/deltas") == ["batch=10", "batch=11", *[f"batch={n}" for n in range(5, 10)]]


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    """A batch of two rows on a state of 5,000 writes two rows; put twice it changes nothing more."""
    many = spark.range(5000).selectExpr("cast(id as string) id", "'x' hash", "timestamp '2024-01-01 00:00:00' updated_at")
    kept = KeyedState(spark, str(tmp_path / "s"), many.schema)
    kept.put(many, 0)
    two = spark.createDataFrame([("7", "y", dt.datetime(2024, 1, 2)), (None, "n", None)], SCHEMA)
    kept.put(two, 1)
    once = sorted(map(tuple, kept.rows().where("id is null or id = '7'").collect()), key=repr)
    kept.put(two, 1)
    assert spark.read.parquet(str(tmp_path / "s/deltas/batch=1")).count() == 2
    assert len(folders(str(tmp_path / "s/deltas/batch=1"))) <= 2
    assert sorted(map(tuple, kept.rows().where("id is null or id = '7'").collect()), key=repr) == once and kept.rows().count() == 5001
    kept.put(two.limit(0), 2)
    assert kept.rows().count() == 5001


def test_repeats_on_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    minute = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    files = [[("a", 1), ("a", 2), ("b", 3)], [("a", 4), ("c", 30)], [("b", 1), ("c", 31), ("a", 32)]]
    for k, rows in enumerate(files):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "ts": minute(m)}) for i, m in rows))
        stream = spark.readStream.schema("id string, ts timestamp").json(str(source))
        without_repeats(stream, ["id"], "ts", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.id, r.ts.minute) for r in spark.read.parquet(out).collect())
    # one a key; b of minute 1 is later than the watermark allows, a comes again once it is forgotten
    assert [g for g in got if g[0] != "a"] == [("b", 3), ("c", 30)] and len([g for g in got if g[0] == "a"]) == 2
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, m)) for i, m in files[0]], "id string, ts timestamp")
    assert sorted((r.id, r.ts.minute) for r in without_repeats(rows, ["id"], "ts", "1 minute").collect()) == [("a", 1), ("b", 3)]


def test_limits_on_a_stream_and_a_table(spark, tmp_path):
    """Files in order of time give what one pass over the table gives; records of past windows are forgotten."""
    r, source, out = random.Random(2), tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    limits = Limits(requests=6, window=300_000_000, burst=3, burst_window=20_000_000)
    start, number, rows = dt.datetime(2024, 1, 1), 0, []
    for k in range(4):
        part = []
        for _ in range(40):
            number += 1
            part.append((r.choice(["a", "b", None]), start + dt.timedelta(seconds=600 * k + r.randint(0, 400)), number))
        rows += part
        (source / f"{k}.json").write_text("\n".join(json.dumps({"ip": i, "ts": t.isoformat() + "Z", "request": n}) for i, t, n in part))
        stream = spark.readStream.schema("ip string, ts timestamp, request long").json(str(source))
        query = limited(stream, "ip", limits).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    table = spark.createDataFrame(rows, "ip string, ts timestamp, request long")
    got, want = (sorted(map(tuple, d.select("ip", "ts", "request", "allowed", "remaining", "reset").collect()), key=repr) for d in (spark.read.parquet(out), limited(table, "ip", limits)))
    assert got == want and len(got) == 160
    assert 0 < sum(x[3] for x in got) < 160
    # an hour later only the key that asks has a record
    (source / "9.json").write_text(json.dumps({"ip": "z", "ts": "2024-01-01T05:00:00Z", "request": 999}))
    query = limited(spark.readStream.schema("ip string, ts timestamp, request long").json(str(source)), "ip", limits).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    (source / "99.json").write_text(json.dumps({"ip": "z", "ts": "2024-01-01T05:00:01Z", "request": 1000}))
    query = limited(spark.readStream.schema("ip string, ts timestamp, request long").json(str(source)), "ip", limits).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_limits_by_hand(spark):
    """Two in a short window, three in a long one; windows begin with a request and end after their last moment."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(s), n) for n, s in enumerate([0, 1, 2, 10, 11, 12, 13, 100, 101, 102, 200, 201, 202, 203])]
    limits = Limits(requests=3, window=100_000_000, burst=2, burst_window=10_000_000)
    got = limited(spark.createDataFrame(rows, "ip string, ts timestamp, request long"), "ip", limits).orderBy("request").collect()
    # the short window of 0 ends after 10 and the long one after 100; each begins anew with the next request
    assert [r.allowed for r in got] == [True, True, False, False, True, False, False, False, True, True, True, False, True, False]
    assert [r.remaining for r in got] == [2, 1, 1, 1, 0, 0, 0, 0, 2, 1, 0, 0, 2, 2]
