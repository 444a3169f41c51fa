"""Structured data in pages (JSON-LD, Open Graph, microdata), feed formats, declared fields."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from marquee.functions.extract import transformed
from marquee.functions.text import collapse
from marquee.sources import feeds

# fixed values: elements without an end tag
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks that are JSON, in order."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())


def open_graph(html: Column) -> Column:
    """Map of the og properties; the last of equal names counts."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    pairs = F.transform(metas, lambda m: F.struct(F.regexp_extract(m, r"""(?i)property=["']og:([^"']+)["']""", 1).alias("k"), F.regexp_extract(m, r"""(?i)content=["']([^"']*)["']""", 1).alias("v")))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(F.filter(pairs, lambda p: p["k"] != ""), empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


class _Items(HTMLParser):
    """Properties of every itemscope; one within several scopes belongs to each."""

    def __init__(self) -> None:
        super().__init__()
        self.items: list[dict[str, str]] = []
        self.open: list[tuple[str, dict | None, str | None, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        name = given.get("itemprop")
        value = next((given[a] for a in ("content", "datetime", "href", "src") if given.get(a)), None)
        if name and value is not None:
            self._put(name, value)
        scope = {"type": given.get("itemtype") or ""} if "itemscope" in given else None
        if scope is not None:
            self.items.append(scope)
        if tag not in VOID:
            self.open.append((tag, scope, name if name and value is None and scope is None else None, []))

    def _put(self, name, value):
        for _, scope, _, _ in self.open:
            if scope is not None:
                scope.setdefault(name, value)

    def handle_data(self, data):
        for _, _, name, parts in self.open:
            if name:
                parts.append(data)

    def handle_endtag(self, tag):
        if any(t == tag for t, *_ in self.open):
            while self.open:
                t, _, name, parts = self.open.pop()
                if name:
                    self._put(name, " ".join("".join(parts).split()))
                if t == tag:
                    break


def _items(html: str | None) -> list[dict[str, str]]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return parser.items


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def microdata(html: pd.Series) -> pd.Series:
    """A map for each itemscope; nesting needs a parser, so this is an Arrow UDF."""
    return html.map(_items)


def structured_events(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, kind, title, date, location, url: events of JSON-LD, then microdata, then Open Graph."""
    j = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("_b", p), F.lit("")) for p in paths])
    ld = pages.select(key, F.explode(json_ld(F.col(html))).alias("_b")).where(F.get_json_object("_b", "$.@type").contains("Event"))
    ld = ld.select(key, F.lit("json-ld").alias("kind"), j("$.name").alias("title"), j("$.startDate").alias("date"), j("$.location.name", "$.location").alias("location"), j("$.url").alias("url"))
    at = lambda k: F.nullif(F.try_element_at("_m", F.lit(k)), F.lit(""))
    marked = pages.where(F.col(html).contains("itemscope"))  # pages without items don't go to Python
    micro = marked.select(key, F.explode(microdata(F.col(html))).alias("_m")).where(F.try_element_at("_m", F.lit("type")).contains("Event"))
    micro = micro.select(key, F.lit("microdata").alias("kind"), at("name").alias("title"), at("startDate").alias("date"), at("location").alias("location"), at("url").alias("url"))
    og = pages.select(key, open_graph(F.col(html)).alias("_m")).where(at("title").isNotNull())
    og = og.select(key, F.lit("open-graph").alias("kind"), at("title").alias("title"), F.coalesce(at("event:start_time"), at("start_time")).alias("date"), at("site_name").alias("location"), at("url").alias("url"))
    return ld.unionByName(micro).unionByName(og)


def feed_format(content_type: Column, content: Column) -> Column:
    """rss, ical or json by content type, else by how the content begins; null if unknown."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.ltrim(content)
    declared = F.when(kind.contains("calendar"), "ical").when(kind.contains("json"), "json").when(kind.contains("rss") | kind.contains("xml"), "rss")
    seen = F.when(head.startswith("BEGIN:VCALENDAR"), "ical").when(head.startswith("<?xml") | F.lower(head).startswith("<rss"), "rss").when(head.startswith("{") | head.startswith("["), "json")
    return F.coalesce(declared, seen)


def feed_events(docs: DataFrame) -> DataFrame:
    """format, title, date, location of feeds (content_type, content) of any known format."""
    docs = docs.withColumn("_f", feed_format(F.col("content_type"), F.col("content")))
    of = lambda f: docs.where(F.col("_f") == f)
    parts = [
        feeds.rss(of("rss")).select(F.lit("rss").alias("format"), "title", "date", "location"),
        feeds.ical(of("ical")).select(F.lit("ical").alias("format"), "title", F.col("start").alias("date"), "location"),
        feeds.json_events(of("json")).select(F.lit("json").alias("format"), "title", "date", "location"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feed_rejects(docs: DataFrame) -> DataFrame:
    """The feeds (content_type, content) that give no rows, with why: no content, unknown format, or no item."""
    kind = feed_format(F.col("content_type"), F.col("content"))
    item = F.when(kind == "rss", F.col("content").rlike("(?i)<item[ >]")).when(kind == "ical", F.col("content").contains("BEGIN:VEVENT")).when(kind == "json", F.col("content").rlike(r"\[\s*\{"))
    why = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "no content").when(kind.isNull(), "unknown format").when(~item, "no item")
    return docs.withColumn("why", why).where("why is not null")


_CLASS = r'(?is)<[a-z0-9]+[^>]*\bclass="[^"]*\b(?:{0})\b[^"]*"[^>]*>\s*([^<]+)'
#: Where pages without markup for machines have their fields (fixed values): patterns with one group, first to last.
PAGE_FIELDS = {
    "title": (_CLASS.format("event-title|event-name"), r"(?is)<h1[^>]*>\s*([^<]+)", r'(?i)<meta[^>]+property="og:title"[^>]+content="([^"]+)"', r"(?is)<title[^>]*>\s*([^<]+)"),
    "description": (_CLASS.format("event-description|description"), r'(?i)<meta[^>]+(?:property="og:description"|name="description")[^>]+content="([^"]+)"'),
    "date": (r'(?i)<time[^>]+datetime="([^"]+)"', _CLASS.format("event-date|date|start-date")),
    "venue": (_CLASS.format("venue|event-venue|location"),),
    "address": (_CLASS.format("address|venue-address"),),
    "price": (_CLASS.format("price|ticket-price|event-price"),),
    "image": (r'(?i)<meta[^>]+property="og:image"[^>]+content="([^"]+)"', r'(?i)<img[^>]+src="([^"]+)"'),
    "url": (r'(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', r'(?i)<meta[^>]+property="og:url"[^>]+content="([^"]+)"'),
}


def page_events(pages: DataFrame, key: str = "page_id", html: str = "html", own: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """key and ``PAGE_FIELDS`` of every page with a title: for each field the first pattern that finds something; ``own`` ones go first."""
    first = lambda ps: F.coalesce(*[F.nullif(collapse(F.regexp_extract(html, p, 1)), F.lit("")) for p in ps])
    fields = {n: first((*(own or {}).get(n, ()), *ps)) for n, ps in PAGE_FIELDS.items()}
    return pages.select(key, *[c.alias(n) for n, c in fields.items()]).where("title is not null")


def json_feed(docs: DataFrame, content: str = "content") -> DataFrame:
    """title (else summary), url, date of a JSON feed's items; without title they go."""
    row = docs.where(F.get_json_object(content, "$.version").isNotNull()).select(F.explode(F.from_json(F.get_json_object(content, "$.items"), "array<map<string,string>>")).alias("_r"))
    at = lambda *ks: F.coalesce(*[F.nullif(F.trim(F.try_element_at("_r", F.lit(k))), F.lit("")) for k in ks])
    return row.select(at("title", "summary").alias("title"), at("url").alias("url"), at("date_published").alias("date")).where("title is not null")


def declared_rows(pages: DataFrame, container: str, fields: dict[str, dict], html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each match of ``container`` (a pattern, group 1), with the declared fields.

    A field has pattern (group 1), and may have multiple, required, fallback, transform
    and params. A missing value takes the fallback; rows that lack a required one go.
    """
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(container), F.lit(1))).alias("place", "_c"))
    for name, f in fields.items():
        if f.get("multiple"):
            found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("_c", F.lit(f["pattern"]), F.lit(1)), lambda v: collapse(v)), lambda v: v != ""))
        else:
            found = F.nullif(collapse(F.regexp_extract("_c", f["pattern"], 1)), F.lit(""))
            found = F.coalesce(found, F.lit(f["fallback"])) if "fallback" in f else found
        rows = rows.withColumn(name, transformed(found, f.get("transform"), f.get("params"), bool(f.get("multiple"))))
    for name, f in fields.items():
        if f.get("required"):
            rows = rows.where(F.size(name) > 0 if f.get("multiple") else F.col(name).isNotNull())
    return rows.drop("_c")


def allowed_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) that no rule (host, disallow: a prefix, empty: none) forbids."""
    r = rules.where("disallow != ''").select(F.col("host").alias("_h"), F.col("disallow").alias("_d"))
    return urls.join(r, (F.col("host") == F.col("_h")) & F.startswith("path", "_d"), "left_anti")
