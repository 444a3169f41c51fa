import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import changes
from marquee.operators.listings import ListingQuery
from marquee.plans.components import connected_components
from marquee.plans.prefix import global_rank
from marquee.streaming.ingest import ingest_stream


def test_query_arguments():
    with pytest.raises(ValueError):
        ListingQuery(dt.datetime(2024, 1, 1), page=0)
    with pytest.raises(ValueError):
        ListingQuery(dt.datetime(2024, 1, 1), sort="price")


def test_components_of_chains_and_empty(spark):
    rng = random.Random(1)
    ids = list(range(60))
    rng.shuffle(ids)
    links = [*zip(ids, ids[1:]), (100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(60), 0) | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("x"), "id")
    got = global_rank(rows, [F.col("x"), F.col("id")], "rank").orderBy("x", "id").collect()
    assert [r["rank"] for r in got] == list(range(1000))


def test_upsert_keeps_first_created(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id long, v string, created_at long")
    new = spark.createDataFrame([(2, "c", 20), (3, "d", 20)], "id long, v string, created_at long")
    assert {tuple(r) for r in changes.upsert(old, new).collect()} == {(1, "a", 10), (2, "c", 10), (3, "d", 20)}


def test_stream_keeps_newest(spark, tmp_path):
    schema = "id string, hash string, updated_at timestamp"
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    for k, rows in enumerate([[("a", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("b", "1", "2024-01-01")], [("a", "3", "2024-01-03")]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "hash": h, "updated_at": f"{d}T00:00:00Z"}) for i, h, d in rows))
        ingest_stream(spark, str(source), schema, state, str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: (r["hash"], r["change"], r["first_seen"].day) for r in spark.read.parquet(f"{state}/v1").collect()}
    assert got == {"a": ("3", "updated", 2), "b": ("1", "new", 1)}
