"""Scraped items to listing records by a declared mapping, detail pages joined to items, scraper configs checked.

Defined cases: a field that doesn't exist, or is null, is null in the record and no item of an array; a null URL joins no
detail page; of detail pages there is one a URL; empty tables give empty results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.extract import TRANSFORMS, transformed
from marquee.functions.hashing import ingest_hash
from marquee.functions.text import absolute_url, listing_id

# fixed values: actions of a workflow with the fields each must have, and fields of a target that take arrays
ACTIONS = {"navigate": ("url",), "wait": (), "click": ("selector",), "scroll": (), "extract": ("containerSelector", "fields")}
ARRAYS = ("artists", "genre", "images")


def nested(rows: DataFrame, path: str) -> Column:
    """The value at a dotted path of columns and struct fields; null where a part doesn't exist."""
    kind, column = rows.schema, None
    for name in path.split("."):
        if getattr(kind, "fieldNames", None) is None or name not in kind.fieldNames():
            return F.lit(None)
        kind = kind[name].dataType
        column = F.col(f"`{name}`") if column is None else column.getField(name)
    return column


def field_or_literal(rows: DataFrame, value: object) -> Column:
    """A column of that name (or dotted path), else the value itself; null for None."""
    if isinstance(value, str) and value.split(".")[0] in rows.columns:
        return nested(rows, value)
    return F.lit(value)


def target_field(rows: DataFrame, spec: object, name: str) -> Column:
    """One field of the target by its spec: a name or literal, or {field, transform, params}; a scalar fills an array's one place."""
    if isinstance(spec, dict):
        value = transformed(field_or_literal(rows, spec["field"]), spec.get("transform"), spec.get("params"), spec.get("is_array", False))
    else:
        value = field_or_literal(rows, spec)
    is_array = spec.get("is_array", False) if isinstance(spec, dict) else isinstance(spec, str) and dict(rows.dtypes).get(spec, "").startswith("array")
    if name in ARRAYS and not is_array:
        return F.array_compact(F.array(value.cast("string")))
    return value


def mapped_records(items: DataFrame, mapping: dict, source: str, base_url: str, as_of: dt.datetime) -> DataFrame:
    """Listing records of scraped ``items`` (``place``: their order in the scrape).

    ``mapping`` names title, artists, genre, date_start, date_end, venue (name, address, city, country), tickets_url,
    event_url and images, each as ``target_field`` has it. URLs are made absolute. The id comes from venue, title, start
    and city, the hash from what was mapped; source_id is the place.
    """
    get = lambda name: target_field(items, mapping.get(name), name)
    url = lambda name: absolute_url(F.nullif(get(name).cast("string"), F.lit("")), base_url)
    venue = F.struct(*[field_or_literal(items, mapping.get("venue", {}).get(p)).cast("string").alias(p) for p in ("name", "address", "city", "country")])
    texts = {n: get(n).cast("string") for n in ("title", "date_start", "date_end")}
    arrays = {n: get(n) for n in ("artists", "genre")}
    images = F.transform(get("images"), lambda i: absolute_url(i, base_url))
    links = {n: url(n) for n in ("tickets_url", "event_url")}
    made = {"source": F.lit(source), "source_id": F.col("place").cast("string"), **texts, **arrays, **links, "images": images, "venue": venue, "status": F.lit("scheduled"), "updated_at": F.lit(as_of).cast("timestamp_ntz")}
    rows = items.select(*[c.alias(n) for n, c in made.items()])
    hashed = ingest_hash(F.col("venue"), title=F.col("title"), artists=F.col("artists"), dateStart=F.col("date_start"), dateEnd=F.col("date_end"), status=F.col("status"), ticketsUrl=F.col("tickets_url"), eventUrl=F.col("event_url"))
    made_id = listing_id(F.col("venue.name"), F.col("title"), F.col("date_start"), F.col("venue.city"))
    return rows.withColumns({"id": made_id, "hash": hashed})


def followed(items: DataFrame, details: DataFrame, url: str) -> DataFrame:
    """``items`` with the fields of their detail pages (one row a ``url``), which override where they aren't null."""
    found = details.withColumnRenamed(url, "_url").select("_url", *[F.col(c).alias(f"_d_{c}") for c in details.columns if c != url])
    joined = items.join(found, items[url] == F.col("_url"), "left")
    own = [F.coalesce(f"_d_{c}", c).alias(c) if c in details.columns and c != url else F.col(c) for c in items.columns]
    more = [F.col(f"_d_{c}").alias(c) for c in details.columns if c != url and c not in items.columns]
    return joined.select(*own, *more)


def config_errors(config: dict) -> list[str]:
    """What is wrong with a scraper's config; empty if nothing."""
    out = [f"missing {k}" for k in ("site", "workflow", "mapping") if k not in config]
    site = config.get("site", {})
    out += [f"missing site.{k}" for k in ("name", "source", "baseUrl") if site and not site.get(k)]
    for k, step in enumerate(config.get("workflow", [])):
        kind = step.get("type")
        if kind not in ACTIONS:
            out.append(f"workflow {k}: unknown type {kind}")
            continue
        out += [f"workflow {k}: missing {f}" for f in ACTIONS[kind] if f not in step]
        fields = step.get("fields", {}) if kind == "extract" else {}
        out += [f"workflow {k}: unknown transform {f['transform']}" for f in fields.values() if f.get("transform") not in (None, *TRANSFORMS)]
    mapping = config.get("mapping", {})
    out += [f"missing mapping.{k}" for k in ("title", "venue", "date_start") if config.get("mapping") is not None and k not in mapping]
    check = config.get("validation", {})
    if check.get("minEventsExpected", 0) > check.get("maxEventsExpected", float("inf")):
        out.append("validation: more events expected at least than at most")
    return out


def with_defaults(config: dict) -> dict:
    """A config with what may be left out: rate limit, schedule, trust, validation (fixed values)."""
    plain = {"rateLimit": {"requestsPerMinute": 10}, "schedule": "0 */3 * * *", "trustScore": 80, "validation": {"minEventsExpected": 0, "required": ["title"]}}
    return {**plain, **config}
