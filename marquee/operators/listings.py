"""Listing queries: filters, sort, page, facets.

Defined cases: a test on a null value doesn't hold, so rows without a start are in no list that hides past ones; null
sort values come first, ties are settled by id; a page past the end is empty; an empty table has no rows, total 0 and 0 pages.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class ListingQuery:
    """What a listing query asks for; ``as_of`` stands for now. Texts match anywhere, case aside.

    With ``early_morning`` a row that starts before six in ``zone`` counts by its UTC day alone: from
    ``date_from`` on, and on ``date_to`` exactly. ``pattern`` is a regular expression over title,
    artists, venue, city and tags.
    """

    as_of: dt.datetime
    city: str | None = None
    source: str | None = None
    tag: str | None = None
    venue: str | None = None
    q: str | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    venues: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    price: tuple[float, float] | None = None
    hours_ahead: int | None = None
    past: bool = False
    early_morning: bool = False
    zone: str = "UTC"
    pattern: str | None = None
    sort: str = "date"
    descending: bool = False
    page: int = 1
    limit: int = 20

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.limit <= 100:
            raise ValueError("page from 1, limit from 1 to 100")
        if self.sort not in ("date", "name", "venue"):
            raise ValueError("sort by date, name or venue")


def _has(x: Column, part: str) -> Column:
    return F.contains(F.lower(x), F.lit(part.lower()))


def _any(*tests: Column) -> Column:
    """One of the tests holds; a test on null doesn't."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


#: Hours ahead by name (fixed values).
HORIZONS = {"today": 24, "week": 168, "month": 720, "all": 8760}


def matching(listings: DataFrame, query: ListingQuery) -> DataFrame:
    """The rows that meet every filter; one conjunction, which Spark pushes to the scan."""
    start, tests = F.col("date_start"), []
    if not query.past:
        tests.append(start >= F.lit(dt.datetime.combine(query.as_of.date(), dt.time())))
    if query.hours_ahead is not None:
        tests.append(start.between(F.lit(query.as_of), F.lit(query.as_of + dt.timedelta(hours=query.hours_ahead))))
    early = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(query.zone), start.cast("timestamp_ntz"))) < 6 if query.early_morning else None
    if query.date_from:
        test = start >= F.lit(dt.datetime.combine(query.date_from, dt.time()))
        tests.append(test if early is None else F.when(early, F.to_date(start) >= F.lit(query.date_from)).otherwise(test))
    if query.date_to:
        test = start < F.lit(dt.datetime.combine(query.date_to, dt.time()) + dt.timedelta(days=1))
        tests.append(test if early is None else F.when(early, F.to_date(start) == F.lit(query.date_to)).otherwise(test))
    for name in ("city", "venue"):
        if getattr(query, name):
            tests.append(_has(F.col(name), getattr(query, name)))
    if query.source:
        tests.append(F.col("source") == query.source)
    if query.tag:
        tests.append(F.exists("tags", lambda t: _has(t, query.tag)))
    if query.tags:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, query.tags))))
    if query.venues:
        tests.append(F.col("venue").isin(*query.venues))
    if query.price:
        tests.append((F.col("price") >= query.price[0]) & (F.col("price") <= query.price[1]))
    if query.q:
        names = [F.exists("artists", lambda a: _has(a, query.q))] if "artists" in listings.columns else []
        tests.append(_any(*[_has(F.col(c), query.q) for c in ("title", "venue", "city")], *names))
    if query.pattern:
        like = lambda c: F.regexp_like(c, F.lit("(?i)" + query.pattern))
        arrays = [F.exists(c, like) for c in ("artists", "tags") if c in listings.columns]
        tests.append(_any(*[like(F.col(c)) for c in ("title", "venue", "city")], *arrays))
    for test in tests:
        listings = listings.where(test)
    return listings


def page(listings: DataFrame, query: ListingQuery) -> DataFrame:
    """A page of the matching rows; ties in the sort are settled by id."""
    key = {"date": F.col("date_start"), "name": F.expr("title collate UNICODE"), "venue": F.expr("venue collate UNICODE")}[query.sort]
    order = key.desc() if query.descending else key.asc()
    return matching(listings, query).orderBy(order, "id").offset((query.page - 1) * query.limit).limit(query.limit)


def pagination(listings: DataFrame, query: ListingQuery) -> DataFrame:
    """total, pages and has_more of the query."""
    total = matching(listings, query).agg(F.count("*").alias("total"))
    return total.select("total", F.ceil(F.col("total") / query.limit).cast("long").alias("pages"), (F.col("total") > query.page * query.limit).alias("has_more"))


def facets(listings: DataFrame, *columns: str) -> DataFrame:
    """facet, value: distinct values of columns (arrays item by item), without null and empty ones, in one pass."""
    kinds = dict(listings.dtypes)

    def of(c: str) -> Column:
        named = lambda v: F.struct(F.lit(c).alias("facet"), v.cast("string").alias("value"))
        if kinds[c].startswith("array"):
            return F.transform(F.coalesce(c, F.array().cast(kinds[c])), named)
        return F.array(named(F.col(c)))

    values = listings.select(F.explode(F.concat(*[of(c) for c in columns])).alias("x"))
    return values.select("x.facet", "x.value").where("value != ''").distinct()


def find(rows: DataFrame, *, source: str | None = None, city: str | None = None, artist: str | None = None, genre: str | None = None, status: str | None = None, first: dt.datetime | None = None, last: dt.datetime | None = None, words: str | None = None, sort: str = "date_start", descending: bool = False, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Stored rows by source, city and artist (regular expressions), genre (exact), status, span of starts and words.

    ``words``: one of them at least is a word of title, venue or an artist. By default the first 1,000 by start.
    """
    like = lambda c, p: F.regexp_like(c, F.lit("(?i)" + p))
    tests = []
    if words:
        said = F.split(F.lower(F.concat_ws(" ", "title", "venue", "artists")), r"[^\p{L}\p{N}#_]+")
        tests.append(F.arrays_overlap(said, F.array(*[F.lit(w) for w in words.lower().split()])))
    tests += [F.col(c) == v for c, v in (("source", source), ("status", status)) if v]
    tests += [like(F.col("city"), city)] if city else []
    tests += [F.exists("artists", lambda a: like(a, artist))] if artist else []
    tests += [F.array_contains("genre", genre)] if genre else []
    tests += [F.col("date_start") >= F.lit(first)] if first else []
    tests += [F.col("date_start") <= F.lit(last)] if last else []
    found = reduce(DataFrame.where, tests, rows)
    key = F.col({"venue": "title", "name": "title", "date": "date_start"}.get(sort, sort))  # a sort by venue is one by title here
    return found.orderBy(key.desc() if descending else key.asc(), "id").offset(offset).limit(limit)


def upcoming(listings: DataFrame, city: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Rows of a city (part of its name) that start within ``days``, by start."""
    until = as_of + dt.timedelta(days=days)
    return listings.where(_has(F.col("city"), city) & F.col("date_start").between(F.lit(as_of), F.lit(until))).orderBy("date_start", "id")


def city_page(page: object = None, limit: object = None) -> tuple[int, int]:
    """Page and limit of a city's list from raw parameters: page from 1, limit 1 to 100, 50 where it is no number."""
    number = lambda x, default: int(x) if str(x).strip().lstrip("-").isdigit() else default
    return max(1, number(page, 1)), min(100, max(1, number(limit, 50)))


def next_page(page: int, pages: int) -> int | None:
    return page + 1 if page < pages else None


def active(query: ListingQuery) -> dict[str, str]:
    """The filters that differ from their defaults, as URL parameters; a text search of under 3 characters is left out."""
    out = {}
    for f in dataclasses.fields(query):
        value = getattr(query, f.name)
        if f.name == "as_of" or value == f.default or f.name == "q" and len(value.strip()) < 3:
            continue
        out[f.name] = ",".join(map(str, value)) if isinstance(value, tuple) else str(value)
    return out


def envelope(listings: DataFrame, query: ListingQuery) -> dict:
    """A page with its pagination and the filters and sort asked for: what an API returns. Holds one page."""
    total, pages, more = pagination(listings, query).first()
    rows = [r.asDict(recursive=True) for r in page(listings, query).collect()]
    return {"data": rows, "pagination": {"page": query.page, "limit": query.limit, "total": total, "pages": pages, "next": next_page(query.page, pages), "has_more": more}, "meta": {"filters": active(query), "sort": query.sort, "descending": query.descending}}
