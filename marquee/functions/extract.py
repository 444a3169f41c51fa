"""Fields taken out of free text, and the registry of named transforms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import dates, event_dates
from marquee.functions.text import WS, absolute_url, collapse, matching_key, normal, trim

# fixed values: words left out of search texts
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with")
# fixed values: marks between artists in a title, first to last; hash keys know the first six
ARTIST_MARKS = (" + ", " & ", " and ", " feat ", " featuring ", " with ", " vs ", " versus ")
# fixed values: parts of a text and the genres they stand for, in order
GENRES = {
    "electronic": "Electronic", "edm": "Electronic", "techno": "Techno", "house": "House", "trance": "Trance", "dubstep": "Dubstep", "drum and bass": "Drum & Bass", "dnb": "Drum & Bass",
    "rock": "Rock", "indie": "Indie", "indie rock": "Indie Rock", "alternative": "Alternative", "punk": "Punk", "metal": "Metal", "hard rock": "Hard Rock",
    "pop": "Pop", "hip hop": "Hip Hop", "hip-hop": "Hip Hop", "rap": "Hip Hop", "r&b": "R&B", "rnb": "R&B",
    "jazz": "Jazz", "blues": "Blues", "soul": "Soul", "funk": "Funk", "folk": "Folk", "country": "Country", "acoustic": "Acoustic",
    "classical": "Classical", "orchestra": "Classical", "symphony": "Classical", "world": "World Music", "latin": "Latin", "reggae": "Reggae",
}
#: Stands between artists while a text is split.
_CUT = "\x01"
# fixed values: what stands between artists on a page, taken in this order; commas outside brackets only
ARTIST_CUTS = (r"(?i)\s+featuring\s+", r"(?i)\s+feat\.?\s+", r"(?i)\s+ft\.?\s+", r"(?i)\s+with\s+", rf",\s*(?![^(){_CUT}]*\))", r"\s+&\s+", r"(?i)\s+and\s+")


def page_text(x: Column) -> Column:
    """Words and plain punctuation of a page's text, single blanks."""
    return collapse(F.regexp_replace(x, rf"(?:(?![A-Za-z0-9_.,!?()@&-]|{WS})[\s\S])", " "))


def artists(x: Column) -> Column:
    """Names between words such as feat, with, and, ampersands and commas outside brackets."""
    x = page_text(x)
    for p in ARTIST_CUTS:
        x = F.regexp_replace(x, p, _CUT)
    return F.filter(F.transform(F.split(x, _CUT), trim), lambda a: F.length(a).between(1, 99))


def _before_mark(title: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(title)
    return F.coalesce(*[F.when(low.contains(m), F.trim(F.substring_index(low, m, 1))) for m in marks], title)


def main_artist(title: Column) -> Column:
    """Normal form of what stands before the first kind of mark that occurs."""
    return normal(_before_mark(title, ARTIST_MARKS))


def artist_key(title: Column, names: Column) -> Column:
    """The first artist, else the title's, as a matching key."""
    return matching_key(F.coalesce(F.try_element_at(names, F.lit(1)), _before_mark(title, ARTIST_MARKS[:6])))


def searchable(x: Column) -> Column:
    return F.array_join(F.filter(F.split(normal(x), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " ")


def address(x: Column) -> Column:
    """struct(address, city, country): the last of three or more parts is the country, the one before it the city."""
    whole = page_text(x)
    parts = F.transform(F.split(whole, ","), trim)
    n = F.size(parts)
    street = F.when(n == 1, whole).when(n == 2, F.get(parts, F.lit(0))).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ", "))
    city = F.when(n == 2, F.get(parts, F.lit(1))).when(n > 2, F.try_element_at(parts, F.lit(-2)))
    return F.struct(street.alias("address"), city.alias("city"), F.when(n > 2, F.try_element_at(parts, F.lit(-1))).alias("country"))


def genres(x: Column) -> Column:
    low = F.lower(x)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in GENRES.items()])))


def venue_label(x: Column) -> Column:
    """A venue's name without a leading The."""
    return trim(F.regexp_replace(page_text(x), rf"(?i)^the{WS}+", ""))


# fixed values: words of a venue's kind that stand apart from its name
VENUE_KINDS = ("Theatre", "Theater", "Hall", "Club", "Bar", "Pub", "Arena", "Stadium")
# fixed values: parts of a text and the city they stand for, in order
CITIES = {"bristol": "Bristol", "london": "London", "nottingham": "Nottingham", "liverpool": "Liverpool", "new york": "New York", "nyc": "New York"}


def spaced_kind(x: Column) -> Column:
    """``venue_label`` with one blank before a kind of venue at its end."""
    return F.regexp_replace(venue_label(x), rf"(?i){WS}*\b({'|'.join(VENUE_KINDS)})$", " $1")


def room_name(x: Column, house: str) -> Column:
    """A room's name after its house's, but for texts that are empty or name the house already."""
    own = F.coalesce(trim(x), F.lit(""))
    return F.when((own == "") | F.lower(own).contains(house.lower()), F.lit(house)).otherwise(F.concat(F.lit(house + ", "), own))


def title_before_date(x: Column) -> Column:
    """What stands before a date such as Thu, 28 Aug; the text itself where there is none."""
    found = trim(F.regexp_extract(x, r"(?s)^(.*?)\w{3},?\s*\d{1,2}\s+\w{3}", 1))
    return F.coalesce(F.nullif(found, F.lit("")), trim(x))


def price_span(x: Column) -> Column:
    """A price or a span of prices in pounds, as written; null if none."""
    return F.nullif(F.regexp_extract(x, r"£\d+(?:\.\d{2})?(?:\s*-\s*£\d+(?:\.\d{2})?)?", 0), F.lit(""))


def city_of(x: Column, default: str) -> Column:
    """The first of the ``CITIES`` that a text names, else ``default``."""
    low = F.lower(x)
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in CITIES.items()], F.lit(default))


def open_slug(x: Column) -> Column:
    """Lower case, all but letters and digits as single hyphens, edges too."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")


def first_match(x: Column, pattern: str) -> Column:
    """The pattern's first group, else its match, else the text."""
    groups = [1, 0] if re.compile(pattern).groups else [0]
    return F.coalesce(*[F.nullif(F.regexp_extract(x, pattern, k), F.lit("")) for k in groups], x)


def replaced(x: Column, pattern: str, by: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(x, ("(?i)" if ignore_case else "") + pattern, by)


#: Named transforms of a scraper's config: (column, parameters) to column.
TRANSFORMS: dict[str, Callable[[Column, dict], Column]] = {
    "trim": lambda x, p: trim(x),
    "lowercase": lambda x, p: F.lower(x),
    "uppercase": lambda x, p: F.upper(x),
    "slug": lambda x, p: open_slug(x),
    "url": lambda x, p: absolute_url(x, p["base"]),
    "date": lambda x, p: F.date_format(F.try_to_timestamp(x, F.lit(p["format"])) if "format" in p else event_dates.parse_start(x, F.lit(None).cast("string"), p["today"], p.get("hour", 19), p.get("dayfirst", False)), "yyyy-MM-dd'T'HH:mm:ss"),
    "iso-date": lambda x, p: F.date_format(dates.parse_iso(x), "yyyy-MM-dd'T'HH:mm:ss"),
    "time-range-start": lambda x, p: F.nullif(F.regexp_extract(x, r"^(\d{1,2}:\d{2})", 1), F.lit("")),
    "time-range-end": lambda x, p: F.nullif(F.regexp_extract(x, r"(\d{1,2}:\d{2})$", 1), F.lit("")),
    "extract-text": lambda x, p: first_match(x, p["pattern"]),
    "regex": lambda x, p: replaced(x, p["pattern"], p.get("replacement", ""), "i" in p.get("flags", "")),
    "literal": lambda x, p: F.lit(p["value"]),
}


def transformed(x: Column, name: str | None, params: dict | None = None, is_array: bool = False) -> Column:
    """A named transform; an unknown name changes nothing. Arrays are done item by item and lose nulls."""
    f = TRANSFORMS.get(name or "", lambda c, p: c)
    if is_array:
        return F.filter(F.transform(x, lambda c: f(c, params or {})), lambda c: c.isNotNull())
    return f(x, params or {})
