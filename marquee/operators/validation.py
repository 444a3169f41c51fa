"""Field by field validation of listing records: sanitised values, errors by kind, warnings.

A record's columns are id, source, title, artists, genre, tags, date_start, date_end, timezone, venue (struct of name,
address, city, country, lat, lng), price (struct of min, max, currency), age_restriction, status, tickets_url,
event_url, images, updated_at and hash; dates are texts. Columns that a table lacks count as null. Types are those of
the table, so a field of the wrong type can't occur. Null, blank and empty values are missing; texts are trimmed.
All of it is one projection over the row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import trim
from marquee.operators.quality import STATUSES

# fixed values: kinds of errors, fields that must be there, and what stands for missing ones
MISSING, DATE, URL, INVALID = "MISSING_REQUIRED_FIELD", "INVALID_DATE_FORMAT", "INVALID_URL_FORMAT", "INVALID_GIG_DATA"
REQUIRED = ("id", "source", "title", "date_start", "venue", "updated_at", "hash")
DEFAULTS = {"source": "unknown", "title": "Untitled Event", "venue": "Unknown Venue", "hash": "auto-generated-hash", "status": "scheduled"}
TYPES = {"artists": "array<string>", "genre": "array<string>", "tags": "array<string>", "images": "array<string>", "venue": "struct<name:string,address:string,city:string,country:string,lat:double,lng:double>", "price": "struct<min:double,max:double,currency:string>"}
FIELDS = ("id", "source", "title", "artists", "genre", "tags", "date_start", "date_end", "timezone", "venue", "price", "age_restriction", "status", "tickets_url", "event_url", "images", "updated_at", "hash")


def _error(kind: str, message: str | Column, field: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(field).alias("field"))


def is_url(x: Column) -> Column:
    """Whether a text has a scheme and, after http or https, a host."""
    return F.coalesce(x.rlike(r"^\s*(?:https?://[^\s/?#]+\S*|(?!https?:)[A-Za-z][A-Za-z0-9+.-]*:\S+)\s*$"), F.lit(False))


def words_of(x: Column) -> Column:
    """An array's items trimmed, without empty and repeated ones; never null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), trim), lambda t: F.coalesce(t != "", F.lit(False))))


def iso(x: Column) -> Column:
    """A date's text in one form, with milliseconds in UTC; null where it can't be read."""
    return F.date_format(F.try_to_timestamp(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def validated_records(rows: DataFrame, as_of: dt.datetime, *, auto_fix: bool = True, strict: bool = False) -> DataFrame:
    """Sanitised ``FIELDS`` with errors (kind, message, field), warnings and is_valid.

    With ``auto_fix`` missing fields but the id and unreadable values get defaults, the dates ``as_of``, and a missing field a
    warning; without it each is an error. A record is valid without errors, or, unless ``strict``, without missing fields.
    """
    kinds = dict(rows.dtypes)
    raw = {c: (F.col(c) if c in kinds else F.lit(None)).cast(TYPES.get(c, "string")) for c in FIELDS}
    blank = lambda c: F.coalesce(trim(raw[c]) == "", F.lit(True))
    missing = {c: raw[c].isNull() if c in TYPES else blank(c) for c in REQUIRED}
    now = F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z")
    fixed = lambda when, kind, message, c: F.lit(None) if auto_fix else F.when(when, _error(kind, message, c))

    # fixed values: the texts of all messages below
    errors = [F.when(missing[c], _error(MISSING, f"Missing required field: {c}", c)) for c in REQUIRED if c == "id" or not auto_fix]
    warnings = [F.when(missing[c], F.lit(f"Auto-fixed missing {c} field")) for c in REQUIRED if c != "id" and auto_fix]
    out = {c: trim(raw[c]) for c in FIELDS if c not in TYPES}
    out |= {c: F.coalesce(F.when(missing[c], F.lit(DEFAULTS[c])), trim(raw[c])) for c in ("source", "title", "hash")}
    for c in ("date_start", "updated_at", "date_end"):
        bad = ~blank(c) & iso(raw[c]).isNull()
        message = F.concat(F.lit(f"Invalid date format for {c}: "), raw[c])
        # an end that can't be read is an error even where others are mended: there is nothing to put in its place
        errors.append(F.when(bad, _error(DATE, message, c)) if c == "date_end" else fixed(bad, DATE, message, c))
        out[c] = iso(raw[c]) if c == "date_end" else F.coalesce(iso(raw[c]), now)
    venue = raw["venue"]
    nameless = F.coalesce(trim(venue["name"]) == "", F.lit(True))
    errors.append(fixed(venue.isNotNull() & nameless, MISSING, "Venue name is required", "venue.name"))
    number = lambda c: F.when(~F.isnan(c), c)
    optional = lambda c: F.nullif(trim(c), F.lit(""))
    name = F.when(nameless, F.lit(DEFAULTS["venue"])).otherwise(trim(venue["name"]))
    out["venue"] = F.struct(name.alias("name"), *[optional(venue[p]).alias(p) for p in ("address", "city", "country")], *[number(venue[p]).alias(p) for p in ("lat", "lng")])
    price = raw["price"]
    parts = {"min": number(price["min"]), "max": number(price["max"]), "currency": optional(F.upper(price["currency"]))}
    out["price"] = F.when(F.coalesce(*[c.cast("string") for c in parts.values()]).isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))
    for c in ("timezone", "age_restriction"):
        out[c] = optional(raw[c])
    known = F.coalesce(raw["status"].isin(*STATUSES), F.lit(False))
    errors.append(fixed(~known, INVALID, F.concat(F.lit("Invalid status: "), F.coalesce(raw["status"], F.lit("null"))), "status"))
    out["status"] = F.when(known, raw["status"]).otherwise(F.lit(DEFAULTS["status"]))
    for c in ("tickets_url", "event_url"):
        errors.append(fixed(~blank(c) & ~is_url(raw[c]), URL, F.concat(F.lit(f"Invalid URL format for {c}: "), raw[c]), c))
        out[c] = F.when(is_url(raw[c]), trim(raw[c]))
    for c in ("artists", "genre", "tags"):
        out[c] = words_of(raw[c])
    images = F.coalesce(raw["images"], F.array().cast("array<string>"))
    bad_images = F.transform(F.filter(images, lambda i: ~is_url(i)), lambda i: _error(URL, F.concat(F.lit("Invalid image URL: "), F.coalesce(i, F.lit("null"))), "images"))
    out["images"] = words_of(F.filter(images, is_url))
    found = F.array_compact(F.array(*errors)).cast("array<struct<kind:string,message:string,field:string>>")
    found = found if auto_fix else F.concat(found, bad_images)
    made = rows.select(*[out[c].alias(c) for c in FIELDS], found.alias("errors"), (F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")).alias("warnings"))
    wrong = F.size("errors") > 0 if strict else F.exists("errors", lambda e: e["kind"] == MISSING)
    return made.withColumn("is_valid", ~wrong)


def batch_totals(records: DataFrame, *by: str) -> DataFrame:
    """total, valid, invalid, errors and warnings of validated records; all, or by columns."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c)
    return records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), size("errors"), size("warnings"))


def result_check(rows: DataFrame, required: tuple[str, ...], least: int = 0, most: int | None = None) -> DataFrame:
    """One row: n, missing (map of dotted field to rows without it) and ok: the count within bounds and no field missing."""
    n = F.count("*")
    absent = {f: F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "") for f in required}
    pairs = [x for f, c in absent.items() for x in (F.lit(f), c)]
    missing = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
    ok = (n >= least) & (n <= most if most is not None else F.lit(True))
    for c in absent.values():
        ok = ok & (c == 0)
    return rows.agg(n.alias("n"), missing.alias("missing"), ok.alias("ok"))
