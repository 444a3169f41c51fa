"""Feeds and pages to rows: RSS, iCal, JSON feeds, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tag(xml: Column, name: str) -> Column:
    raw = F.regexp_extract(xml, rf"(?is)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.nullif(F.trim(raw), F.lit(""))


def rss(docs: DataFrame, content: str = "content") -> DataFrame:
    """title, description, link, date, location, lat, lng, categories of the items with title and date."""
    item = docs.select("*", F.explode(F.regexp_extract_all(content, F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("_i"))
    i = F.col("_i")
    out = item.select(_tag(i, "title").alias("title"), _tag(i, "description").alias("description"), _tag(i, "link").alias("link"), F.coalesce(_tag(i, "pubDate"), _tag(i, "dc:date")).alias("date"), _tag(i, "location").alias("location"), _tag(i, "geo:lat").try_cast("double").alias("lat"), F.coalesce(_tag(i, "geo:long"), _tag(i, "geo:lon")).try_cast("double").alias("lng"), F.regexp_extract_all(i, F.lit(r"(?is)<category[^>]*>(.*?)</category>"), F.lit(1)).alias("categories"))
    return out.where("title is not null and date is not null")


def unescape_ical(x: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ical(docs: DataFrame, content: str = "content") -> DataFrame:
    """uid, title, start, end, location of the events with summary and start."""
    flat = F.regexp_replace(content, "\r?\n[ \t]", "")
    e = docs.select(F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("_e"))
    value = lambda k: F.nullif(unescape_ical(F.regexp_extract("_e", rf"(?m)^{k}(?:;[^:\r\n]*)?:(.*?)\r?$", 1)), F.lit(""))
    return e.select(value("UID").alias("uid"), value("SUMMARY").alias("title"), value("DTSTART").alias("start"), value("DTEND").alias("end"), value("LOCATION").alias("location")).where("title is not null and start is not null")


def json_events(docs: DataFrame, content: str = "content") -> DataFrame:
    """title, date, end, location, description, url, categories of a JSON array of events or an object with ``events``; names vary."""
    text = F.coalesce(F.get_json_object(content, "$.events"), F.col(content))
    row = docs.select(F.explode(F.from_json(text, "array<map<string,string>>")).alias("_r"))
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("_r", F.lit(n))), F.lit("")) for n in names])
    return row.select(first("title", "name", "summary").alias("title"), first("date", "date_start", "start_date", "start", "startDate", "datetime").alias("date"), first("location", "venue", "place", "venue_name").alias("location"), first("end", "date_end", "end_date", "endDate").alias("end"), first("description", "summary", "details").alias("description"), first("url", "link", "event_url").alias("url"), F.from_json(F.coalesce(F.try_element_at("_r", F.lit("categories")), F.try_element_at("_r", F.lit("tags"))), "array<string>").alias("categories")).where("title is not null and date is not null")


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, n_links, n_urls (distinct), host."""
    links = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_urls"), host.alias("host"))
