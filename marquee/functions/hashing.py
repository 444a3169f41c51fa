"""Stable hashes of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.dates import round_hour
from marquee.functions.extract import artist_key
from marquee.functions.text import matching_key


#: Fields of a listing whose change is a change of content (fixed values), sorted.
CONTENT = ("ageRestriction", "artists", "dateEnd", "dateStart", "eventUrl", "images", "status", "tags", "ticketsUrl", "timezone", "title", "venue")
#: Fields of the ingest hash (fixed values), sorted; the venue comes last and counts as an empty object.
INGEST = ("ageRestriction", "artists", "dateEnd", "dateStart", "eventUrl", "status", "tags", "ticketsUrl", "title")


def json_text(fields: dict[str, Column], nulls: bool = False) -> Column:
    """The fields as JSON with sorted keys; null ones are left out, or null literals with ``nulls``.

    Nested structs keep the order they have. Whole doubles are written without a fraction, as 5, not 5.0.
    """
    options = {"ignoreNullFields": str(not nulls).lower()}
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), options)
    return F.regexp_replace(text, r'(?<=[^\\]":)(-?\d+)\.0(?=[,}])', "$1")


def stable_hash(nulls: bool = False, **fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; null fields are left out, or null literals with ``nulls``."""
    return F.sha2(json_text(fields, nulls), 256)


def content_hash(**fields: Column) -> Column:
    """SHA-256 of those of the ``CONTENT`` fields that are given; others don't count, null ones are left out."""
    return stable_hash(**{k: v for k, v in fields.items() if k in CONTENT})


def ingest_hash(venue: Column | None = None, **fields: Column) -> Column:
    """SHA-256 over the ``INGEST`` fields in order, then the venue as ``{}`` where it isn't null: what a venue holds doesn't count."""
    text = json_text({k: v for k, v in fields.items() if k in INGEST})
    if venue is not None:
        glue = F.when(text == "{}", '{"venue":{}}').otherwise(F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"venue":{}}')))
        text = F.when(venue.isNull(), text).otherwise(glue)
    return F.sha2(text, 256)


def fuzzy_key_hash(title: Column, venue: Column, city: Column, date_start: Column, names: Column) -> Column:
    """SHA-256 of what stays of a listing when spelling goes: title (50 characters), venue, city, hour and first artist.

    ``date_start`` is a timestamp; null parts are empty texts.
    """
    text = lambda c: F.coalesce(matching_key(c), F.lit(""))
    hour = F.coalesce(F.date_format(round_hour(date_start), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    artist = F.coalesce(artist_key(F.coalesce(title, F.lit("")), names), F.lit(""))
    return stable_hash(title=F.left(text(title), F.lit(50)), venue=text(venue), city=text(city), dateHour=hour, mainArtist=artist)


def same_hash(a: Column, b: Column) -> Column:
    """Two hashes are equal and not empty; false where one is null."""
    return F.coalesce((a == b) & (F.length(a) > 0), F.lit(False))


def composite_key(venue: Column, title: Column, date_start: Column, city: Column) -> Column:
    """SHA-256 of the four parts joined by bars, quoted as JSON text."""
    return F.sha2(F.concat(F.lit('"'), F.concat_ws("|", venue, title, date_start, city), F.lit('"')), 256)


def quick_hash(x: Column) -> Column:
    """32-bit rolling hash (times 31) of a text's UTF-16 units, as hex of its size."""
    wrap = lambda v: F.pmod(v + 2147483648, F.lit(4294967296)) - 2147483648
    units = F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    value = lambda u: F.conv(u, 16, 10).cast("long")
    return F.lower(F.hex(F.abs(F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + value(u))))))


def is_hash(x: Column) -> Column:
    return x.rlike("(?i)^[a-f0-9]{64}$")
