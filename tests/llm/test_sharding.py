"""Sharding: permutation and inverse, the law's bounds, odd rows, files."""

from __future__ import annotations

import collections
import zlib

from pyspark.sql import functions as F

from marquee.llm import sharding
from marquee.llm.queries import QUERIES


def test_permutations_and_inverses(spark):
    for n in (0, 1, 2, 3, 5, 23, 97, 1000, 4099):
        a, b = sharding.radixes(n)
        assert n <= a * b < max(n, 1) + a and (n < 5 or a > 1)
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, 7, back=True).alias("q")).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.id == r.q for r in rows)
    one, other = ([r[0] for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000, s)).collect()] for s in (1, 2))
    assert sum(x == y for x, y in zip(one, other, strict=True)) < 20


def test_a_walk_outside(spark):
    """Numbers whose first image is no row number are walked on: 4099 is prime, so its radixes have a surplus."""
    a, b = sharding.radixes(4099)
    assert a * b > 4099
    outside = spark.range(4099).where(sharding._once(F.col("id"), 4099, 7) >= 4099).count()
    assert 0 < outside <= a * b - 4099


def test_shuffle_spreads_neighbours(spark):
    n = 20_000
    places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 13)).collect()]
    steps = collections.Counter((q - p) % n * 20 // n for p, q in zip(places, places[1:], strict=False))
    assert max(steps.values()) < 1.3 * n / 20 and min(steps.values()) > 0.7 * n / 20
    shards = [p % 24 for p in places]
    assert max(collections.Counter(zip(shards, shards[1:], strict=False)).values()) < 4 * n / 576


def test_odd_rows(spark):
    rows = [(None, None, "q"), (None, "é", "r"), (3, "a", "s"), (3, "a", "s"), (3, "b", "t"), (-1, "", None)] * 20 + [(k, "same", "u") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("more", F.create_map(F.lit("k"), "text"))
    out = [sharding.sharded(d, shards=7) for d in (docs, docs.repartition(5, "text"))]
    assert out[0].columns == ["doc_id", "text", "more", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number"]
    got = [o.collect() for o in out]
    slots = collections.defaultdict(list)
    for r in got[0]:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda r: (repr(r.doc_id), repr(r.text), r.shard, r.slot)
    assert sorted(map(key, got[0])) == sorted(map(key, got[1]))
    back = out[0].select("row_number", sharding.row_number_at(F.col("shard"), F.col("slot"), len(rows), 7, 13).alias("at")).collect()
    assert all(r.row_number == r["at"] for r in back)
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_files_in_the_order_of_slots(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id long, text string")
    sharding.write_shards(sharding.sharded(docs, shards=4), str(tmp_path / "s"), files=6)
    for shard in range(4):
        slots = []
        for f in sorted((tmp_path / "s" / f"shard={shard}").glob("*.parquet")):
            slots += [r.slot for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == list(range(50))


def test_query(spark):
    rows = QUERIES["op13_sharding"](spark, "/root/testdata/sf0.001").collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
