"""Sources as plugins: registered functions, config files, and their union by name."""

from __future__ import annotations

import datetime as dt
import hashlib
import importlib.util
import json
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.event_dates import at_minute, clock
from marquee.operators.mapping import config_errors, with_defaults

#: name to (fetch, normalise): raw rows of a source, and these as records.
REGISTRY: dict[str, tuple[Callable[[SparkSession], DataFrame], Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, fetch: Callable[[SparkSession], DataFrame], normalise: Callable[[DataFrame], DataFrame]) -> None:
    """Adds or replaces a source; raises TypeError unless both are functions."""
    if not callable(fetch) or not callable(normalise):
        raise TypeError("a plugin is two functions")
    REGISTRY[name] = (fetch, normalise)


def rows_of(spark: SparkSession, name: str, venue: str | None = None) -> DataFrame:
    """The records of a registered source: ``source`` is its name, a missing venue (column ``venue``) the default given."""
    fetch, normalise = REGISTRY[name]
    rows = normalise(fetch(spark)).withColumn("source", F.lit(name))
    return rows.withColumn("venue", F.coalesce("venue", F.lit(venue))) if venue is not None and "venue" in rows.columns else rows


def late_tomorrow(rows: DataFrame, as_of: dt.datetime, when: str = "date_text", start: str = "date_start") -> DataFrame:
    """``rows`` with ``start`` set where the text ``when`` still says tomorrow: the day after ``as_of`` at the text's time, else at seven in the evening."""
    day = F.lit(as_of.date() + dt.timedelta(days=1))
    late = at_minute(day, F.coalesce(clock(F.col(when)), F.lit(19 * 60)))
    return rows.withColumn(start, F.when(F.lower(when).contains("tomorrow"), late).otherwise(F.col(start)))


def config_hash(text: str) -> str:
    """SHA-256 of a config written compactly, its fields in the file's order; whole numbers have no point."""
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x.is_integer() else x
    return hashlib.sha256(json.dumps(plain(json.loads(text)), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def all_rows(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The records of several sources, or of all, one below the other; columns that one lacks are null."""
    parts = [rows_of(spark, n) for n in (names if names is not None else sorted(REGISTRY))]
    if not parts:
        raise ValueError("no source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _config_row(text: str, path: str) -> tuple:
    try:
        config = with_defaults(json.loads(text))
    except (ValueError, TypeError, RecursionError):
        return (None, None, None, None, ["not JSON"], path, None)
    site = config.get("site", {})
    return (site.get("name"), site.get("source"), site.get("baseUrl"), json.dumps(config), config_errors(config), path, config_hash(text))


def read_configs(spark: SparkSession, *paths: str) -> DataFrame:
    """name, source, base_url, config (JSON with defaults), errors, path, hash (of the file's own fields): a row for each config file of the paths (globs), read and parsed by tasks.

    A file that isn't JSON has one error and no name.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])
    names = ["name", "source", "base_url", "config", "errors", "path", "hash"]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_config_row(t, p) for t, p in zip(b["text"], b["path"], strict=True)], columns=names, dtype=object)

    return files.mapInPandas(parsed, "name string, source string, base_url string, config string, errors array<string>, path string, hash string")


def load_folder(path: str) -> list[str]:
    """Registers the plugins of a folder: each ``*.py`` file that has functions ``fetch`` and ``normalise``, under its name. Returns those names.

    A file that lacks one raises TypeError before any is registered; names that begin with ``_`` are left out.
    """
    found = {}
    for file in sorted(Path(path).glob("[!_]*.py")):
        spec = importlib.util.spec_from_file_location(f"marquee_plugin_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        pair = getattr(module, "fetch", None), getattr(module, "normalise", None)
        if not all(map(callable, pair)):
            raise TypeError(f"{file.name} lacks fetch or normalise")
        found[file.stem] = pair
    for name, pair in found.items():
        register(name, *pair)
    return list(found)


def override_union(code: DataFrame, config: DataFrame, key: str = "name") -> DataFrame:
    """Plugins of both kinds by ``key``; where both have one, config's columns win. ``kind`` says where a row is from: code or config."""
    others = [c for c in code.columns if c != key]
    a, b = code.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in others]), config.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in others])
    kind = F.when(F.col("_b").isNotNull(), "config").otherwise("code")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_b", "_a").alias(key), *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in others], kind.alias("kind"))


def breakdown(plugins: DataFrame, key: str = "name") -> DataFrame:
    """kind, n and the sorted names of plugins; these are few."""
    return plugins.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("names"))


def enabled(rows: DataFrame, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sources that may run: those allowed, if any are named, else all but those denied."""
    return rows.where(F.col("source").isin(*allow)) if allow else rows.where(~F.col("source").isin(*deny)) if deny else rows


def in_both(allow: tuple[str, ...], deny: tuple[str, ...]) -> list[str]:
    """Sources that are allowed and denied: a contradiction."""
    return sorted(set(allow) & set(deny))
