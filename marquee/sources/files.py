"""Snapshot files of sources, and dated JSON-lines logs with retention."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_name(file: Column) -> Column:
    """A source's name from a file's: lower case, without its endings."""
    return F.lower(F.regexp_replace(file, r"(?i)(?:\.normalized|\.raw)?\.json$", ""))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replaces the snapshot of the sources in ``rows`` (column source); others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").json(path)


def read_snapshots(spark: SparkSession, path: str, schema: str, modified_after: dt.datetime | None = None) -> DataFrame:
    """Rows of ``*.normalized.json`` files ({"gigs": [...]}) with their source; files that aren't JSON give none."""
    reader = spark.read.schema(f"gigs array<struct<{schema}>>").option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.normalized.json")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.json(path).select("gigs", source_name(F.col("_metadata.file_name")).alias("_source"))
    return files.select("_source", F.explode("gigs").alias("_g")).select(F.col("_source").alias("file_source"), "_g.*")


def append_log(rows: DataFrame, path: str, when: str = "timestamp") -> None:
    """Adds rows as JSON lines, in a folder for each day."""
    rows.withColumn("date", F.to_date(when)).write.mode("append").partitionBy("date").json(path)


def read_log(spark: SparkSession, path: str, schema: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Log rows of the days from ``first`` to ``last``; only those folders are read, bad lines are skipped."""
    rows = spark.read.schema(f"{schema}, date date").option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("date") >= F.lit(first)) if first else rows
    return rows.where(F.col("date") <= F.lit(last)) if last else rows


def drop_old_days(spark: SparkSession, path: str, today: dt.date, keep_days: int = 30) -> list[str]:
    """Deletes the folders of days before ``keep_days`` ago; the driver sees one name a day."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest, gone = today - dt.timedelta(days=keep_days), []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < oldest.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name[5:])
    return sorted(gone)


def write_envelopes(rows: DataFrame, path: str, kind: str, as_of: dt.datetime) -> None:
    """Replaces the ``raw`` or ``normalized`` rows of the sources in ``rows``, and each one's envelope (time and count).

    Rows lie as JSON lines in a folder for each source; the envelopes are one small table beside them, so no
    source's rows have to fit into one document.
    """
    write_snapshot(rows, f"{path}/{kind}")
    heads = rows.groupBy("source").agg(F.count("*").alias("count")).withColumn("at", F.lit(as_of).cast("timestamp_ntz"))
    write_snapshot(heads, f"{path}/{kind}-envelopes")


def read_source(spark: SparkSession, path: str, kind: str, source: str, schema: str) -> DataFrame:
    """The rows of one source; none where the folder or the source doesn't exist. Only that source's folder is read."""
    at = f"{path}/{kind}/source={source}"
    try:
        return spark.read.schema(schema).json(at).withColumn("source", F.lit(source))
    except AnalysisException:
        return spark.createDataFrame([], schema).withColumn("source", F.lit(source))


def sources_in(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """source, count and at of every envelope, by source."""
    return spark.read.schema("count long, at timestamp_ntz, source string").json(f"{path}/{kind}-envelopes").orderBy("source")


def write_catalog(rows: DataFrame, path: str, as_of: dt.datetime, version: str = "1.0") -> None:
    """Writes a catalogue: its rows by start, the statistics of each source and one row of metadata."""
    rows.orderBy("date_start", "id").write.mode("overwrite").parquet(f"{path}/rows")
    counts = rows.groupBy("source").agg(F.count("*").alias("total"), F.max("updated_at").alias("last_update"))
    counts.write.mode("overwrite").parquet(f"{path}/sources")
    head = rows.agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"))
    head.withColumns({"version": F.lit(version), "generated_at": F.lit(as_of).cast("timestamp_ntz")}).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a catalogue; raises ValueError where its metadata don't agree with them."""
    rows, head = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/metadata").first()
    if head is None or head["total"] != rows.count():
        raise ValueError("the catalogue is incomplete")
    return rows


def listing_of_document(rows: DataFrame) -> DataFrame:
    """Stored documents as listings: no internal columns, ``gigId`` as id, timestamps as texts in UTC."""
    stamp = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    kept = [c for c in rows.columns if c not in ("_id", "_meta", "createdAt")]
    kinds = dict(rows.dtypes)
    return rows.select(*[stamp(c) if kinds[c].startswith("timestamp") else F.col(c).alias("id" if c == "gigId" else c) for c in kept])


def latest_by(rows: DataFrame, when: str, n: int, **equal: str) -> DataFrame:
    """The ``n`` newest rows with these values in columns."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows.orderBy(F.desc(when)).limit(n)
