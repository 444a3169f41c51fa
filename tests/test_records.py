"""Records: hashes, validation, mapping, plugins, merges, groups, files, listings, with nulls, ties and empty tables."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates, event_dates, extract, hashing, similarity, text
from marquee.operators import changes, dedupe, listings, mapping, stats, validation
from marquee.operators.listings import ListingQuery
from marquee.plans.prefix import global_rank
from marquee.plans.skew import lookup, may_be_in
from marquee.plans.staging import discard, staged
from marquee.sources import files, plugins
from marquee.streaming.ingest import ingest_stream
from tests import plain_similarity

NOW = dt.datetime(2025, 8, 12, 10)


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", type(None): "string", list: "array<string>", dt.datetime: "timestamp_ntz"}
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return rows.select(column).first()[0]


def sha(value):
    return hashlib.sha256(json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_hashes(spark):
    c = F.col
    assert one(spark, hashing.stable_hash(b=c("b"), a=c("a")), a="é/\"", b=None) == sha({"a": "é/\""})
    assert one(spark, hashing.stable_hash(True, b=c("b"), a=c("a")), a=5.0, b=None) == sha({"a": 5, "b": None})
    assert one(spark, hashing.content_hash(title=c("t"), price=c("p")), t='x":5.0,', p=3) == sha({"title": 'x":5.0,'})
    assert one(spark, hashing.ingest_hash(F.struct("v"), title=c("t")), t="x", v="any") == sha({"title": "x", "venue": {}})
    assert one(spark, hashing.ingest_hash(F.struct("v"), title=c("t")), t=None, v="any") == sha({"venue": {}})
    want = sha({"title": "blue feat red", "venue": "", "city": "city", "dateHour": "2024-03-15T20:00:00.000Z", "mainArtist": "blue"})
    assert one(spark, hashing.fuzzy_key_hash(c("t"), c("v"), c("c"), c("d"), c("a")), t="Blue feat Red!", v=None, c="City", d=dt.datetime(2024, 3, 15, 19, 30), a=[]) == want
    assert one(spark, hashing.same_hash(c("a"), c("b")), a="", b="") is False and one(spark, hashing.same_hash(c("a"), c("b")), a="x", b=None) is False

    def rolling(s):
        h = 0
        for k in range(0, len(b := s.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(b[k : k + 2], "big") + 2**31) % 2**32 - 2**31
        return f"{abs(h):x}"

    for s in ("abc", "", "a😀b and more of it"):
        assert one(spark, hashing.quick_hash(F.col("s")), s=s) == rolling(s)


def brute_folded(a, b):
    s, t = sorted((a.lower().strip(), b.lower().strip()), key=len)
    if s == t:
        return 1.0
    if not s:
        return 0.0
    reach, used, left = max(len(t) // 2 - 1, 0), set(), []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(i + reach + 1, len(t))):
            if j not in used and t[j] == ch:
                used.add(j)
                left.append(ch)
                break
    if not left:
        return 0.0
    m, swaps = len(left), sum(x != t[j] for x, j in zip(left, sorted(used)))
    j = (m / len(s) + m / len(t) + (m - swaps / 2) / m) / 3
    same = 0
    while same < min(4, len(s)) and s[same] == t[same]:
        same += 1
    return j + 0.1 * same * (1 - j)


def test_folded_likeness(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcAB ") for _ in range(r.randrange(9))) for _ in range(60)]
    for a, b in zip(words, reversed(words)):
        assert plain_similarity.folded(a, b) == pytest.approx(brute_folded(a, b))
    assert one(spark, similarity.text_similarity(F.col("a"), F.col("b")), a="x", b=None) is None


def test_texts_and_days(spark):
    x = F.col("x")
    assert [one(spark, dates.time_zone(x), x=v) for v in ("GMT+1", "Event at 8 PM", "at 9 CET", "utc", None)] == ["GMT+1", None, "CET", "UTC", None]
    assert one(spark, extract.spaced_kind(x), x="The Town   Hall") == "Town Hall" and one(spark, extract.room_name(x, "Exchange"), x=None) == "Exchange"
    assert one(spark, extract.price_span(x), x="from £5 - £7.50 now") == "£5 - £7.50" and one(spark, extract.price_span(x), x="5") is None
    assert one(spark, text.compare_trust(F.lit("official-a"), F.lit("b")), x="") == 60
    assert dates.option_of(*dates.named_range("this-month", dt.date(2025, 8, 12)), dt.date(2025, 8, 12)) == "this-month" and dates.option_of(None, dt.date(2025, 1, 1), dt.date(2025, 8, 12)) == "all"
    none = F.lit(None).cast("string")
    at = lambda site, v: one(spark, event_dates.site_start(site, x, none, NOW), x=v)
    assert at("lanes", "Tomorrow 23:30") == dt.datetime(2025, 8, 13, 23, 30) and at("lanes", None) is None
    assert at("thekla", "Wed.13.Aug.25") == dt.datetime(2025, 8, 13, 12) and at("fleece", "") == event_dates.SENTINEL
    assert at("electric", "27th August 2025") == dt.datetime(2025, 8, 27, 19) and at("croft", "?") == NOW


def gigs(spark, *rows):
    return spark.createDataFrame(rows, "id string, source string, title string, date_start string, venue struct<name:string,address:string,city:string,country:string,lat:double,lng:double>, updated_at string, hash string, status string, tickets_url string, images array<string>, date_end string")


def test_validation(spark):
    venue = (" Hall ", "", "Bristol", None, 0.0, float("nan"))
    good = ("1", "s", " T ", "2024-03-15T20:00:00Z", venue, "2024-03-01T10:00:00Z", "h", "scheduled", " https://x.y/z ", ["https://a.b/c", "https://a.b/c", "no", None], None)
    bare = (None,) * 11
    odd = ("2", "s", "T", "soon", (None,) * 6, "2024-03-01", "h", "on-sale", "nowhere", [], "late")
    rows = gigs(spark, good, bare, odd)
    a, b, c = validation.validated_records(rows, NOW).collect()
    assert a["is_valid"] and not a["errors"] and not a["warnings"] and a["title"] == "T" and a["date_start"] == "2024-03-15T20:00:00.000Z"
    assert tuple(a["venue"]) == ("Hall", None, "Bristol", None, 0.0, None) and a["tickets_url"] == "https://x.y/z" and a["images"] == ["https://a.b/c"] and a["price"] is None
    assert not b["is_valid"] and [e["field"] for e in b["errors"]] == ["id"] and len(b["warnings"]) == 6
    assert (b["source"], b["title"], b["venue"]["name"], b["hash"], b["date_start"]) == ("unknown", "Untitled Event", "Unknown Venue", "auto-generated-hash", "2025-08-12T10:00:00.000Z")
    assert c["is_valid"] and [e["field"] for e in c["errors"]] == ["date_end"] and c["status"] == "scheduled" and c["tickets_url"] is None
    a, b, c = validation.validated_records(rows, NOW, auto_fix=False).collect()
    assert [e["field"] for e in a["errors"]] == ["images", "images"] and a["is_valid"]
    assert {e["kind"] for e in c["errors"]} == {validation.DATE, validation.MISSING, validation.INVALID, validation.URL} and not c["is_valid"]
    assert validation.batch_totals(validation.validated_records(rows, NOW, strict=True)).first()[:5] == (3, 1, 2, 2, 6)
    assert validation.batch_totals(validation.validated_records(rows.limit(0), NOW)).first()[:5] == (0, 0, 0, 0, 0)
    assert validation.result_check(rows, ("id", "venue.city"), 1, 2).first()[:] == (3, {"id": 1, "venue.city": 2}, False)


def test_mapping(spark):
    items = spark.createDataFrame([(0, " A ", ["x", None], ("/p",)), (1, None, None, (None,))], "place int, name string, names array<string>, link struct<href:string>")
    spec = {"title": {"field": "name", "transform": "trim"}, "artists": "name", "genre": {"field": "names", "transform": "uppercase", "is_array": True}, "event_url": "link.href", "venue": {"name": "Hall"}, "date_start": "2024-01-01", "images": "no.such"}
    a, b = mapping.mapped_records(items, spec, "s", "https://x.y", NOW).orderBy("source_id").collect()
    assert (a["id"], a["title"], a["artists"], a["genre"], a["event_url"]) == ("hall-a-2024-01-01", "A", [" A "], ["X"], "https://x.y/p")
    assert b["title"] is None and b["artists"] == [] and b["event_url"] is None and b["images"] == ["https://x.y/no.such"]
    assert items.select(mapping.nested(items, "link.href").alias("a"), mapping.nested(items, "link.no").alias("b")).first()[:] == ("/p", None)
    out = mapping.followed(items.select("place", "name"), spark.createDataFrame([(" A ", 7, "d")], "name string, place int, more string"), "name")
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, None, None), (7, " A ", "d")]


def test_configs_and_plugins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plugins, "REGISTRY", {})
    config = {"site": {"name": "a", "source": "a", "baseUrl": "u"}, "workflow": [{"type": "extract", "containerSelector": "x", "fields": {"t": {"transform": "trim"}}}, {"type": "click"}, {"type": "fly"}], "mapping": {"title": "t", "venue": {}, "date_start": "d"}, "validation": {"minEventsExpected": 5, "maxEventsExpected": 2}}
    assert mapping.config_errors(config) == ["workflow 1: missing selector", "workflow 2: unknown type fly", "validation: more events expected at least than at most"]
    (tmp_path / "a.json").write_text(json.dumps(config))
    (tmp_path / "b.json").write_text("no json")
    rows = plugins.read_configs(spark, f"{tmp_path}/*.json", f"{tmp_path}/a*").orderBy("path").collect()
    assert [r["name"] for r in rows] == ["a", None] and json.loads(rows[0]["config"])["trustScore"] == 80 and rows[1]["errors"] == ["not JSON"]
    plugins.register("one", lambda s: s.range(2).withColumn("venue", F.lit(None).cast("string")), lambda d: d)
    plugins.register("two", lambda s: s.range(1).withColumn("extra", F.lit(1)), lambda d: d)
    assert {(r["source"], r["extra"]) for r in plugins.all_rows(spark).collect()} == {("one", None), ("two", 1)}
    assert [r["venue"] for r in plugins.rows_of(spark, "one", "Hall").collect()] == ["Hall", "Hall"]
    with pytest.raises(TypeError):
        plugins.register("x", 1, 2)
    rows = spark.createDataFrame([("a",), ("b",)], "source string")
    assert [r[0] for r in plugins.enabled(rows, ("a",), ("a",)).collect()] == ["a"] and [r[0] for r in plugins.enabled(rows, (), ("a",)).collect()] == ["b"]
    assert plugins.in_both(("a", "c"), ("b", "c")) == ["c"]


def test_greedy_groups(spark):
    r = random.Random(8)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(70)}
    pairs = spark.createDataFrame([(a, b, r.choice([0.9, 0.5]), ["x"]) for a, b in edges], "a int, b int, confidence double, reasons array<string>")
    linked = {}
    for p in pairs.where("confidence >= 0.7").collect():
        linked.setdefault(p["a"], set()).add(p["b"])
        linked.setdefault(p["b"], set()).add(p["a"])
    lead = {}
    for n in sorted(linked):
        if n not in lead:
            for m in [n, *linked[n]]:
                lead.setdefault(m, n)
    groups = dedupe.greedy_groups(pairs)
    assert {x["node"]: x["lead"] for x in groups.collect()} == lead
    assert sum(x["n"] for x in dedupe.group_reasons(groups, pairs).collect()) == sum(list(lead.values()).count(v) for v in set(lead.values()) if list(lead.values()).count(v) > 1)
    assert dedupe.greedy_groups(pairs.limit(0)).collect() == []


def test_large_blocks(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"b{k % 40}") for k in range(120)] + [(None, "hot")], "id int, block string")
    got = {tuple(r) for r in dedupe.candidate_pairs(rows, F.array("block"), block_rows=7).collect()}
    blocks = {k: "hot" if k % 3 else f"b{k % 40}" for k in range(120)}
    assert got == {(a, b) for a in blocks for b in blocks if a < b and blocks[a] == blocks[b]}
    firsts, membership = dedupe.collapsed(rows.where("id is not null"), F.when(F.col("block") == "hot", F.col("block")))
    assert sorted(r["id"] for r in firsts.collect()) == [0, 1, *range(3, 120, 3)]
    assert sum(r["first"] == 1 for r in membership.collect()) == 80 and membership.count() == 120
    events = spark.createDataFrame([("a", k, k if k in (30, 500) else None) for k in range(1000)] + [("b", 5, None), (None, 1, 7), (None, 2, None)], "k string, o int, h int")
    got = {(r["k"], r["o"]): r["g"] for r in stats.fill_forward(events.repartition(8), "k", "o", F.col("h"), "g").collect()}
    assert got == {("a", k): 30 if k < 500 else 500 for k in range(30, 1000)} | {(None, 1): 7, (None, 2): 7}
    seconds = [0, 0, 5, 59, 60, 61, 200, 259, 260]
    hits = spark.createDataFrame([("a", s) for s in seconds], "k string, s long")
    assert sorted((r["s"], r["n_within"]) for r in stats.requests_within(hits, "k", F.col("s"), 60).collect()) == sorted((s, sum(s - 60 <= t <= s for t in seconds)) for s in seconds)


def test_merges(spark):
    schema = "g string, source string, ord int, id int, title string, status string, price double, artists array<string>, tags array<string>, venue struct<name:string,address:string,city:string,country:string,lat:double,lng:double>, event_url string, updated_at int"
    v = lambda name, city: (name, None, city, "", None, 0.0)
    rows = spark.createDataFrame([
        ("a", "hi", 2, 2, "two", "s", None, ["y", "x"], ["t"], v("", "B"), "u2", 5),
        ("a", "hi", 1, 1, "one", "s", 3.0, ["x", None], None, v("N", None), "", 4),
        ("a", "lo", 0, 0, "low", "s", 9.0, ["low"], ["low"], v("L", "L"), "low", 9),
        ("b", "lo", 3, 3, None, None, None, None, None, None, None, None),
        (None, "lo", 4, 4, "none", "s", 1.0, [], [], None, None, 1),
    ], schema)
    trust = text.trust(F.col("source"), {"hi": 90, "lo": 20})
    got = {r["g"]: r for r in dedupe.merge_listings(rows, "g", trust).collect()}
    a = got["a"]
    assert set(got) == {"a", "b"} and (a["id"], a["title"], a["event_url"], a["updated_at"], a["n"], a["price"]) == (1, "one", "u2", 5, 2, 3.0)
    assert a["artists"] == ["x", None, "y"] and a["tags"] == ["t"] and tuple(a["venue"])[:3] == ("N", None, "B") and got["b"]["tags"] == []
    small = {r["g"]: (r["title"], r["price"], r["tags"], r["n"]) for r in dedupe.merge_by_trust(rows, "g", trust).collect()}
    assert small == {"a": ("one", 3.0, ["t"], 2), "b": (None, None, [], 1)}
    assert dedupe.merge_listings(rows.limit(0), "g", trust).collect() == []
    assert [r["n"] for r in dedupe.same_content(rows.withColumn("t", F.lit("x")), F.col("t")).collect()] == [5]
    assert [len(r["rows"]) for r in dedupe.by_id(rows.withColumn("id", F.lit(1))).collect()] == [5]


def test_statistics(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 3)], "k string, t string, n int")
    assert {r["k"]: (r["requests"], r["hit_rate"]) for r in stats.hit_rates(rows.where("k is not null"), "k", F.col("t") == "x").collect()} == {"a": (2, 0.5), None: (2, 0.5)}
    assert [(r["requests"], r["hit_rate"]) for r in stats.hit_rates(rows.limit(0), "k", F.col("t") == "x").collect()] in ([], [(0, 0.0)])
    when = [dt.datetime(2024, 1, 1, 0, 0, k // 3) for k in range(9)]
    got = stats.rate_limited(spark.createDataFrame([("a", t, i) for i, t in enumerate(when)], "k string, ts timestamp_ntz, i int"), "k", "ts", "i", 7, 2).orderBy("i").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True, False, True, False, False]
    assert {r["name"]: r["n"] for r in stats.counts({"a": rows, "b": rows.limit(0)}).collect()} == {"a": 3, "b": 0}
    changed = spark.createDataFrame([("updated",), ("new",), (None,)], "change string")
    assert [r["ord"] for r in changes.in_order(changed).collect()] == [2, 1, None]


def test_listing_tools(spark):
    schema = "id int, source string, title string, venue string, city string, date_start timestamp_ntz, artists array<string>, tags array<string>, genre array<string>, status string, updated_at timestamp_ntz"
    day = dt.datetime(2025, 8, 20, 3)
    rows = spark.createDataFrame([(1, "s", "Night", "Hall", None, day, ["Blue"], None, ["Jazz"], "scheduled", day), (2, "s", "Day", None, "Bristol", day + dt.timedelta(hours=9), None, ["Rock"], None, None, None)], schema)
    ids = lambda q: sorted(r["id"] for r in listings.matching(rows, q).collect())
    assert ids(ListingQuery(NOW, q="blue")) == [1] and ids(ListingQuery(NOW, pattern="^ro")) == [2] and ids(ListingQuery(NOW, pattern="h|d")) == [1, 2]
    late = dt.date(2025, 8, 21)
    assert ids(ListingQuery(NOW, date_to=late)) == [1, 2] and ids(ListingQuery(NOW, date_to=late, early_morning=True)) == [2]
    assert ids(ListingQuery(NOW, date_to=late, early_morning=True, zone="Asia/Tokyo")) == [1, 2]
    assert sorted(map(tuple, listings.facets(rows, "city", "tags").collect())) == [("city", "Bristol"), ("tags", "Rock")]
    assert [r["id"] for r in listings.find(rows, words="hall x", genre="Jazz").collect()] == [1]
    assert listings.city_page("x", "1000") == (1, 100) and listings.city_page("-3", None) == (1, 50) and listings.next_page(2, 2) is None
    assert listings.active(ListingQuery(NOW, q="ab", city="x", tags=("a", "b"))) == {"city": "x", "tags": "a,b"}
    out = listings.envelope(rows, ListingQuery(NOW, limit=1))
    assert (len(out["data"]), out["pagination"]["total"], out["pagination"]["next"], out["pagination"]["has_more"]) == (1, 2, 2, True)
    assert listings.envelope(rows.limit(0), ListingQuery(NOW))["data"] == []


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, id int")
    files.write_envelopes(rows, str(tmp_path), "raw", NOW)
    files.write_envelopes(rows.where("source = 'b'"), str(tmp_path), "raw", NOW)
    assert sorted(r["id"] for r in files.read_source(spark, str(tmp_path), "raw", "a", "id int").collect()) == [1, 2]
    assert files.read_source(spark, str(tmp_path), "raw", "none", "id int").collect() == []
    assert [(r["source"], r["count"]) for r in files.sources_in(spark, str(tmp_path), "raw").collect()] == [("a", 2), ("b", 1)]
    day = dt.datetime(2025, 1, 1)
    catalogue = spark.createDataFrame([(1, "a", day, day), (2, "b", None, None)], "id int, source string, date_start timestamp_ntz, updated_at timestamp_ntz")
    files.write_catalog(catalogue, str(tmp_path / "c"), NOW)
    assert files.read_catalog(spark, str(tmp_path / "c")).count() == 2
    catalogue.limit(1).write.mode("overwrite").parquet(str(tmp_path / "c/rows"))
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(tmp_path / "c"))
    stored = spark.createDataFrame([("x", "g", day)], "_id string, gigId string, updatedAt timestamp_ntz")
    assert files.listing_of_document(stored).first().asDict() == {"id": "g", "updatedAt": "2025-01-01T00:00:00.000Z"}
    assert [r["id"] for r in files.latest_by(catalogue, "updated_at", 1, source="a").collect()] == [1]


def test_late_rows_in_the_stream(spark, tmp_path):
    state, source = str(tmp_path / "state"), tmp_path / "in"
    source.mkdir()
    schema = "id string, hash string, updated_at timestamp"

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("id", "hash", "updated_at"), r))) for r in rows))
        ingest_stream(spark, str(source), schema, state, str(tmp_path / "check"), keep=2).awaitTermination()

    put("1.json", ("a", "new", "2025-01-05T00:00:00Z"), ("b", "b", "2025-01-01T00:00:00Z"))
    put("2.json", ("a", "old", "2025-01-01T00:00:00Z"), ("b", "b2", "2025-01-01T00:00:00Z"))
    put("3.json", ("c", "c", "2025-01-01T00:00:00Z"))
    assert {r["id"]: r["hash"] for r in spark.read.parquet(f"{state}/v2").collect()} == {"a": "new", "b": "b2", "c": "c"}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v1", "v2"]


def test_plans(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(3000)] + [(None, -1)], "k int, v int")
    table = staged(spark.createDataFrame([(1, "hot", 2000), (3, "three", 1), (9999, "none", 1)], "k int, name string, n int"), "t")
    for how, n in (("inner", 2001), ("left", 3001)):
        got = lookup(rows, table, ["k"], "n", how).collect()
        assert len(got) == n and sum(r["name"] == "hot" for r in got) == 2000 and sum(r["name"] == "three" for r in got) == 1
    discard(table, table)
    with pytest.raises(Exception, match="(?i)exist|found"):
        table.collect()
    got, on, working = may_be_in(rows, F.col("v").cast("long"), spark.range(0, 3000, 7))
    assert got.where(on & (F.col("v") % 7 == 0)).drop(*working).count() == 429 and got.where(~on).count() > 2000
    ranked = global_rank(rows.withColumn("v", F.col("v") % 50), [F.col("v"), F.col("k")], "place").collect()
    assert sorted(r["place"] for r in ranked) == list(range(3001)) and [r["v"] for r in sorted(ranked, key=lambda r: r["place"])] == sorted(r["v"] for r in ranked)


def test_costly_columns_are_worked_out_once_a_value(spark):
    """10,000 rows of three texts and null, one text on most rows; a Python function counts what reaches it."""
    from marquee.plans.skew import once_each

    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        met.add(1)
        return f"<{x}>"

    x = F.when(F.col("id") % 1000 == 0, F.lit(None)).when(F.col("id") % 100 == 1, "b").when(F.col("id") % 100 == 2, "c").otherwise("a")
    rows = spark.range(10_000).select("id", x.alias("x"))
    got = once_each(rows, "x", y=costly(F.col("x"))).collect()
    assert len(got) == 10_000 and {r.id for r in got} == set(range(10_000)) and all(r.y == f"<{r.x}>" for r in got)
    assert met.value == 13  # three texts, and ten rows without one
