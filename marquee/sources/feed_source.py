"""A folder of feed files as a Spark source: ``spark.read.format("feed_files").load(folder)``, or as a stream.

Rows: path, source (the file's name without endings, lower case), kind (rss, ical, json, html, by ending, else null),
content_type, modified and content. Planning lists the folder once and deals its files to partitions of about
``bytes`` each (an option; a larger file goes alone), so tasks read, and the driver holds names and sizes only. Filters on
source, kind and modified are pushed: files that they exclude are in no partition. ``structured.feed_events``
takes these rows as they are.

As a stream, an offset is the time (ms) and path of the newest file seen; files that appear later with an older time are not
seen, so writers should move finished files in. Defined cases: a folder without files has no rows; content that isn't UTF-8 has
its wrong bytes replaced; hidden files (``.``, ``_``) are left out.
"""

from __future__ import annotations

import json
import mimetypes
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "path string, source string, kind string, content_type string, modified timestamp, content string"
# fixed values: kinds and content types by ending
KINDS = {"rss": ("rss", "application/rss+xml"), "xml": ("rss", "application/xml"), "ics": ("ical", "text/calendar"), "json": ("json", "application/json"), "html": ("html", "text/html"), "htm": ("html", "text/html")}
_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class _File:
    path: str
    size: int
    ms: int

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    def value(self, column: str):
        """What the file's row has in a column that can be told from its name and time."""
        end = self.name.rpartition(".")[2].lower() if "." in self.name else ""
        kind = KINDS.get(end, (None, mimetypes.guess_type(self.name)[0]))
        return {"path": self.path, "source": self.name.split(".")[0].lower(), "kind": kind[0], "content_type": kind[1], "modified": datetime.fromtimestamp(self.ms / 1000, UTC)}[column]


@dataclass
class _Part(InputPartition):
    folder: str
    files: list[_File]


def _listed(folder: str) -> list[_File]:
    system, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((_File(f.path, f.size, (f.mtime_ns or 0) // 1_000_000) for f in files), key=lambda f: (f.ms, f.path))


def _dealt(folder: str, files: list[_File], most: int) -> list[_Part]:
    parts: list[list[_File]] = []
    room = 0
    for f in files:
        if f.size > room or not parts:
            parts.append([])
            room = most
        parts[-1].append(f)
        room -= f.size
    return [_Part(folder, p) for p in parts]


def _rows(part: _Part) -> Iterator[tuple]:
    system, _ = fs.FileSystem.from_uri(part.folder if "://" in part.folder or part.folder.startswith("file:") else f"file://{part.folder}")
    for f in part.files:
        with system.open_input_stream(f.path) as data:
            content = data.read().decode("utf-8", "replace")
        yield (f.path, *(f.value(c) for c in ("source", "kind", "content_type", "modified")), content)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most, self.tests = folder, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("source", "kind", "modified", "path") and type(f) in (*_COMPARED, In):
                self.tests.append((column, type(f).__name__, f.value))
            else:
                yield f

    def _kept(self, f: _File) -> bool:
        for column, name, value in self.tests:
            own = f.value(column)
            aware = lambda v: v.replace(tzinfo=UTC) if isinstance(v, datetime) and v.tzinfo is None else v
            if own is None:
                return False
            if not (own in [aware(v) for v in value] if name == "In" else next(t for k, t in _COMPARED.items() if k.__name__ == name)(own, aware(value))):
                return False
        return True

    def partitions(self) -> list[_Part]:
        return _dealt(self.folder, [f for f in _listed(self.folder) if self._kept(f)], self.most) or [_Part(self.folder, [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"ms": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"ms": files[-1].ms, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        key = lambda o: (o["ms"], o["path"])
        return _dealt(self.folder, [f for f in _listed(self.folder) if key(start) < (f.ms, f.path) <= key(end)], self.most)

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(partition)


class FeedFiles(DataSource):
    """See the module; options: path, bytes (of a partition, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("feed_files needs a path")
        return self.options["path"], int(self.options.get("bytes", 64 << 20))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(*self._given())

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(*self._given())


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedFiles)
