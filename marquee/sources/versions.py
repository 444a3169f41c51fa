"""Catalogues in versions: tables written side by side, one pointer moved last.

A version is a folder of tables that nothing changes afterwards. ``CURRENT`` names the newest whole
one and is replaced by a rename, so a reader sees all tables of one version or of another, and a failed
writer leaves a folder that nothing points to. A ``Catalogue`` stays with the version that it opened until it is told to refresh.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans.files import exists, folders, opened, remove, written


def write_version(tables: dict[str, DataFrame], path: str, as_of: dt.datetime, keep: int = 2) -> str:
    """Writes ``tables`` as a new version below ``path`` and points to it; the last ``keep`` versions stay. Returns its name."""
    last = current(path)
    number = int(last["version"].split("-")[1]) + 1 if last else 1
    version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{version}/{name}")
    with written(f"{path}/CURRENT") as out:
        out.write(json.dumps({"version": version, "at": as_of.isoformat(), "tables": sorted(tables)}).encode())
    known = [f for f in folders(path) if f.startswith("v-") and int(f.split("-")[1]) <= number - keep]
    for old in known:
        remove(f"{path}/{old}")
    return version


def current(path: str) -> dict | None:
    """The pointer: version, at, tables; nothing where no version has been written."""
    if not exists(f"{path}/CURRENT"):
        return None
    with opened(f"{path}/CURRENT") as f:
        return json.loads(f.read())


class Catalogue:
    """A reader of one version; ``refresh`` moves on to the newest where the one read is older than ``max_age``."""

    def __init__(self, spark: SparkSession, path: str, as_of: dt.datetime, max_age: dt.timedelta = dt.timedelta(minutes=5)) -> None:
        self.spark, self.path, self.max_age = spark, path, max_age
        self._open(as_of)

    def _open(self, as_of: dt.datetime) -> None:
        self.pointer, self.read_at = current(self.path), as_of

    def refresh(self, as_of: dt.datetime) -> bool:
        """Whether another version is read from now on; the pointer is looked at only once in ``max_age``."""
        if as_of - self.read_at < self.max_age:
            return False
        before = self.pointer
        self._open(as_of)
        return self.pointer != before

    def table(self, name: str) -> DataFrame:
        if self.pointer is None or name not in self.pointer["tables"]:
            raise ValueError(f"no table {name} in the catalogue")
        return self.spark.read.parquet(f"{self.path}/{self.pointer['version']}/{name}")


def catalogue_tables(rows: DataFrame, as_of: dt.datetime, version: str = "1.0") -> dict[str, DataFrame]:
    """Rows by start, the statistics of each source and one row of metadata, for ``write_version``."""
    counts = rows.groupBy("source").agg(F.count("*").alias("total"), F.max("updated_at").alias("last_update"))
    head = rows.agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"))
    head = head.withColumns({"version": F.lit(version), "generated_at": F.lit(as_of).cast("timestamp_ntz")}).coalesce(1)
    return {"rows": rows.orderBy("date_start", "id"), "sources": counts, "metadata": head}
