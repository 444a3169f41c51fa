"""Text functions as Column builders. White space is JavaScript's; word bounds are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s   -     　﻿]"
#: The characters of ``WS``.
_BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# fixed values: words that carry no meaning in matching, and abbreviations that are spelled out
EVENT_WORDS = ("the", "live", "concert", "show", "event")
STREETS = {"st": "street", "rd": "road", "ave": "avenue", "dr": "drive"}
VENUE_WORDS = ("club", "bar", "pub", "venue", "hall", "center", "centre", "theatre", "theater", "arena", "stadium")
TITLE_WORDS = ("presents", "featuring", "feat", "ft", "with", "plus", "vs", "versus")
RELEASE_WORDS = ("tour", "world tour", "live", "album", "ep", "single")
# fixed values: the marks that matching leaves out; all others stay
MARKS = ".,!?;:-_()[]{}\"|'`~@#$%^&*+=<>/\\"
CITY_WORDS = ("city", "town", "borough", "county")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def _given(x: Column, test, then) -> Column:
    """``then(x)`` where ``test(x)``, else ``x``, which is worked out once: most texts need no replacement, and a look is far cheaper than one."""
    return F.transform(F.array(x), lambda y: F.when(test(y), then(y)).otherwise(y))[0]


def _holds(x: Column, words) -> Column:
    """Whether a word's letters occur; only then are its bounds looked at."""
    found = F.lit(False)
    for w in words:
        found = found | x.contains(w)
    return found


def collapse(x: Column) -> Column:
    blanks = F.translate(x, _BLANKS, " " * len(_BLANKS))
    return F.trim(_given(blanks, lambda y: y.contains("  "), lambda y: F.regexp_replace(y, " +", " ")))


def drop_words(x: Column, words: tuple[str, ...]) -> Column:
    return collapse(_given(x, lambda y: _holds(y, words), lambda y: F.regexp_replace(y, f"{_L}(?:{'|'.join(words)}){_R}", "")))


def slug(x: Column) -> Column:
    """Lower case, word characters joined by single hyphens."""
    kept = F.regexp_replace(trim(F.lower(x)), rf"(?:(?![A-Za-z0-9_-]|{WS})[\s\S])", "")
    return F.regexp_replace(F.regexp_replace(kept, f"(?:{WS}|[_-])+", "-"), "^-+|-+$", "")


def listing_id(venue: Column, title: Column, date_start: Column, city: Column) -> Column:
    """Slug of venue, title, start and city; empty parts are skipped."""
    return slug(F.concat_ws("-", *[F.nullif(c, F.lit("")) for c in (venue, title, date_start, city)]))


def normal(x: Column) -> Column:
    """Text for matching: no case, listed marks or event words, ``and`` as an ampersand, street names spelled out. Null stays null."""
    y = F.translate(F.lower(x), MARKS, "")
    y = _given(y, lambda z: z.contains("and"), lambda z: F.regexp_replace(z, f"{_L}and{_R}", "&"))

    def spelled(z: Column) -> Column:
        for short, full in STREETS.items():
            z = F.regexp_replace(z, f"{_L}{short}{_R}", full)
        return z

    return _given(drop_words(y, EVENT_WORDS), lambda z: _holds(z, STREETS) & z.rlike(f"{_L}(?:{'|'.join(STREETS)}){_R}"), spelled)


def _without(x: Column, *lists: tuple[str, ...]) -> Column:
    """A normal text without the words of each list in turn."""
    for words in lists:
        x = _given(x, lambda y: _holds(y, words), lambda y: drop_words(y, words))  # noqa: B023
    return x


def normal_venue(x: Column) -> Column:
    return _without(normal(x), VENUE_WORDS)


def normal_title(x: Column) -> Column:
    return _without(normal(x), TITLE_WORDS, RELEASE_WORDS)


def normal_city(x: Column) -> Column:
    return _without(normal(x), CITY_WORDS)


def matching_key(x: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", ""), r"\s+", " "))


def price(x: Column) -> Column:
    """struct(min, max, currency): free words give 0; a symbol, then a code, gives the currency."""
    low = F.lower(x)
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"\b\d+(?:[.,]\d{2})?\b"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))
    free = low.rlike(f"{_L}(?:free|gratis|no charge){_R}")
    currency = F.coalesce(*[F.when(x.contains(s), F.lit(c)) for s, c in (("$", "USD"), ("€", "EUR"), ("£", "GBP"))], F.nullif(F.upper(F.regexp_extract(x, r"(?i)\b(USD|EUR|GBP)\b", 1)), F.lit("")))
    return F.struct(
        F.when(free, 0.0).otherwise(F.array_min(numbers)).alias("min"),
        F.when(free, 0.0).otherwise(F.array_max(numbers)).alias("max"),
        F.when(~free, currency).alias("currency"),
    )


def trust(source: Column, table: dict[str, int] | None = None) -> Column:
    """Trust of a source: a table's value between 0 and 100, else by patterns in its name."""
    low = F.lower(source)
    by_name = F.when(low.contains("official") | low.contains("direct"), 90).when(low.contains("venue") | low.contains(".com"), 70).when(low.contains("facebook") | low.contains("instagram"), 55).otherwise(30)
    given = [F.when(low == k.lower(), F.lit(max(0, min(100, v)))) for k, v in (table or {}).items()]
    return F.coalesce(*given, by_name)


def compare_trust(a: Column, b: Column, table: dict[str, int] | None = None) -> Column:
    """Trust of source ``a`` less that of ``b``."""
    return trust(a, table) - trust(b, table)


def absolute_url(url: Column, base: str) -> Column:
    root = base.rstrip("/")
    return F.when(url.startswith("http"), url).when(url.startswith("/") | url.startswith("#"), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(root + "/"), url))
