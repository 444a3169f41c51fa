"""Queries of single functions and small operators over the driver's tables, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import dates, event_dates, extract, hashing, text
from marquee.operators import changes, dedupe, sources
from marquee.plans import views
from marquee.plans.staging import new_path
from marquee.queries import _L, _N, AS_OF
from marquee.sources import files, plugins, structured, versions
from marquee.sources.tables import table
from marquee.streaming.expiry import Limits, limited, without_repeats
from marquee.streaming.state import KeyedState

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query("""SELECT o_orderkey, abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1998-06-15 12:00:00')) / 3600000.0 AS hours, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y at %I:%M %p') AS shown,
CASE WHEN o_orderkey % 45 BETWEEN 1 AND 31 THEN CAST(o_orderkey % 45 AS INT) END AS day, o_orderdate AS parsed FROM orders""")
def date_values(spark, sf):
    """Hours from a moment, the long display, a day's ordinal, and ISO texts read back."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    iso = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "orders").select(
        "o_orderkey", event_dates.hours_between(d, F.lit(AS_OF).cast("timestamp_ntz")).alias("hours"), event_dates.displayed(d).alias("shown"),
        event_dates.day_number(F.concat((key % 45).cast("string"), F.lit("th"))).alias("day"), dates.parse_iso(iso).cast("timestamp_ntz").alias("parsed"),
    )


@_query("""SELECT o_orderkey, (o_orderkey % 24) || ':30' AS first, ((o_orderkey + 2) % 24) || ':00' AS last, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start, '-o' || lower(o_orderstatus) || '-' || o_orderkey || '-' AS slug, 'k' || o_orderkey AS part, 'order # of ' || o_orderkey AS other FROM orders""")
def named_transforms(spark, sf):
    """Transforms of a scraper's config, by name."""
    key = F.col("o_orderkey").cast("string")
    span = F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":30 - "), ((F.col("o_orderkey") + 2) % 24).cast("string"), F.lit(":00"))
    t = extract.transformed
    return table(spark, sf, "orders").select(
        "o_orderkey", t(span, "time-range-start").alias("first"), t(span, "time-range-end").alias("last"), t(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "iso-date").alias("start"),
        t(F.concat(F.lit(" O"), "o_orderstatus", F.lit(" - "), key, F.lit("!")), "slug").alias("slug"), t(F.concat(F.lit("id=k"), key, F.lit(";")), "extract-text", {"pattern": "id=([a-z0-9]+)"}).alias("part"),
        t(F.concat(F.lit("ORDER no of "), key), "lowercase").alias("other"),
    ).withColumn("other", t(F.col("other"), "regex", {"pattern": "NO", "replacement": "#", "flags": "i"}))


@_query("""SELECT c_custkey, c_name || ' & co. (live)' AS page, '1 High St ' || c_custkey AS address, n_name AS city, CASE WHEN c_custkey % 2 = 0 THEN 'UK' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""".replace("c_name || ' & co. (live)'", "replace(c_name, '#', ' ') || ' & co. (live)'"))
def page_values(spark, sf):
    """A page's text without odd characters, and addresses cut at commas."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    where = F.concat(F.lit("1 High St "), F.col("c_custkey").cast("string"), F.lit(", "), "n_name", F.when(F.col("c_custkey") % 2 == 0, ", UK").otherwise(""))
    a = extract.address(where)
    page = extract.page_text(F.concat(F.lit("  "), "c_name", F.lit(" {& \t co.} [(live)]")))
    return rows.select("c_custkey", page.alias("page"), a["address"].alias("address"), a["city"].alias("city"), a["country"].alias("country"))


@_query(_N + "SELECT n.id, n.hash = p.hash AS same, CASE n.id % 3 WHEN 0 THEN TRUE ELSE FALSE END AS valid FROM n JOIN p USING (id)")
def hash_checks(spark, sf):
    """Equal hashes of two snapshots, and whether a text is a hash."""
    a, b = (views.snapshot(spark, sf, new).select("id", F.col("hash").alias(n)) for new, n in ((True, "a"), (False, "b")))
    x = F.when(F.col("id") % 3 == 0, F.upper("a")).when(F.col("id") % 3 == 1, F.substring("a", 1, 63)).otherwise("")
    return a.join(b, "id").select("id", hashing.same_hash(F.col("a"), F.col("b")).alias("same"), hashing.is_hash(x).alias("valid"))


@_query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'O' || o_orderkey ELSE o_orderpriority END AS title, 'http://x.example/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def json_feed_items(spark, sf):
    """A JSON feed for each order: titles, summaries in their place, and an item with neither."""
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"title": "O'), key, F.lit('"'))).otherwise(F.concat(F.lit('"summary": "'), "o_orderpriority", F.lit('"')))
    item = F.concat(F.lit("{"), name, F.lit(', "url": "http://x.example/'), key, F.lit('", "date_published": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}'))
    body = F.concat(F.lit('{"version": "https://jsonfeed.org/version/1", "items": ['), item, F.lit(', {"url": "x"}]}'))
    return structured.json_feed(table(spark, sf, "orders").select(body.alias("content")))


_PARTS = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path"


@_query(f"WITH u AS (SELECT page_id, {_PARTS} FROM pages) SELECT page_id, host, path FROM u WHERE NOT (length(host) % 2 = 0 AND (starts_with(path, '/de/') OR starts_with(path, '/fr/1')))")
def allowed_pages(spark, sf):
    """Pages that their hosts' rules don't forbid: every second host forbids two prefixes, and one empty rule forbids nothing."""
    url = F.col("url")
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    hosts = pages.where(F.length("host") % 2 == 0).select("host").distinct()
    return structured.allowed_urls(pages, hosts.select("host", F.explode(F.array(F.lit("/de/"), F.lit("/fr/1"), F.lit(""))).alias("disallow")))


@_query(_L + "SELECT id, source, price >= 150000 AS pricing FROM l WHERE source IN ('BUILDING', 'MACHINERY')")
def enabled_sources(spark, sf):
    """Rows of allowed sources, and whether a trust made of the price will do for prices."""
    rows = plugins.enabled(views.listings(spark, sf), ("BUILDING", "MACHINERY"), ("BUILDING", "FURNITURE"))
    score = F.when(F.col("price") >= 150_000, 80).otherwise(79)
    return rows.select("id", "source", sources.trusted_for(score, "pricing").alias("pricing"))


@_query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def latest_errors(spark, sf):
    """The 100 newest errors."""
    return files.latest_by(table(spark, sf, "events"), "ts", 100, event_type="error").select("event_id", "user_id", "ts")


@_query(_L + "SELECT source, count(*) AS n, CAST(TIMESTAMP '1998-06-15 12:00:00' AS TIMESTAMP) AS written_at FROM l GROUP BY source")
def written_envelopes(spark, sf):
    """Envelopes of sources, written and read back."""
    path = new_path(spark, "envelopes")
    files.write_envelopes(views.listings(spark, sf).select("source", "id", "title"), path, "raw", AS_OF)
    return files.sources_in(spark, path, "raw").select("source", F.col("count").alias("n"), F.col("at").alias("written_at"))


@_query(_L + "SELECT source, count(*) AS total, max(updated_at) AS last_update FROM l GROUP BY source")
def catalogue_statistics(spark, sf):
    """Statistics of the second version of a catalogue."""
    path, rows = new_path(spark, "catalogue"), views.listings(spark, sf)
    for part in (rows.where("id % 2 = 0"), rows):
        versions.write_version(versions.catalogue_tables(part, AS_OF), path, AS_OF)
    return versions.Catalogue(spark, path, AS_OF).table("sources").select("source", "total", "last_update")


@_query("SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY user_id")
def rows_by_user(spark, sf):
    """Each user's events, newest first, and the groups flattened again."""
    rows = table(spark, sf, "events").select("user_id", F.col("ts").alias("updated_at"), "event_id")
    groups = dedupe.by_id(rows, "user_id")
    flat = changes.flattened(groups.select(F.transform("rows", lambda r: F.struct(F.col("user_id").alias("user_id"), r["event_id"].alias("event_id"))).alias("rows")))
    counted = flat.groupBy("user_id").agg(F.count("*").alias("n"))
    return counted.join(groups.select("user_id", F.get("rows", F.lit(0))["event_id"].alias("newest")), "user_id")


@_query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS hash, max(ts) AS updated_at FROM events GROUP BY user_id")
def state_of_batches(spark, sf):
    """The newest event of each user after three batches, late ones among them, in a state of deltas that is compacted once."""
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("hash"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id")
    state = KeyedState(spark, new_path(spark, "state"), events.drop("event_id").schema, every=2)
    for number in range(3):  # dealt by number, so times of all batches overlap
        state.put(events.where(F.col("event_id") % 3 == number).drop("event_id"), number)
    return state.rows().select("id", "hash", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@_query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL")
def first_of_each(spark, sf):
    """The first event of each user and type."""
    return without_repeats(table(spark, sf, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1 hour")


@_query(None)
def limited_requests(spark, sf):
    """Events as requests of their users: three in an hour, two in ten minutes."""
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request"))
    return limited(rows, "user_id", Limits(3, 3_600_000_000, 2, 600_000_000)).select("user_id", "request", "allowed", "remaining")


@_query(_L + "SELECT id, title, city, 'listing' AS kind FROM l WHERE source = 'BUILDING' UNION ALL SELECT n_nationkey, n_name, n_name, 'nation' FROM nation")
def union_of_sources(spark, sf):
    """Two registered sources, one below the other."""
    plugins.register("listing", lambda s: views.listings(s, sf).where("source = 'BUILDING'"), lambda rows: rows.select("id", "title", "city"))
    plugins.register("nation", lambda s: table(s, sf, "nation"), lambda rows: rows.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.col("n_name").alias("city")))
    return plugins.all_rows(spark, ["listing", "nation"]).withColumnRenamed("source", "kind")


@_query(_N + "SELECT p.id, p.price, CASE WHEN n.id % 5 = 0 THEN TIMESTAMP '1998-06-15 12:00:00' ELSE p.first_seen END AS updated_at FROM p LEFT JOIN n USING (id)")
def forced_update_times(spark, sf):
    """A patch that changes nothing but the time of the rows it names."""
    base = views.snapshot(spark, sf, False).select("id", "price", F.col("first_seen").alias("updated_at"))
    named = views.snapshot(spark, sf, True).where("id % 5 = 0").select("id", F.lit(None).cast("double").alias("price"))
    return changes.patch(base, named, as_of=F.lit(AS_OF).cast("timestamp_ntz"))
