"""Incremental runs: a file stream whose batches are put into a state table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.changes import detect_changes
from marquee.operators.stats import latest
from marquee.plans.files import remove


def ingest_stream(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, keep: int = 3) -> StreamingQuery:
    """Reads new JSON files under ``source`` and keeps, under ``state``, the newest row of each id.

    A row older than the one kept, by ``updated_at``, changes nothing, so late files do no harm; of equal ones the later
    file's counts. A batch writes a new version of the state by its number, so a repeated batch overwrites its own
    version; the last ``keep`` versions stay. Rows carry ``hash``, ``updated_at``; ``change`` and ``first_seen`` are added.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = latest(batch, "id", "updated_at", "hash")
        empty = rows.withColumn("first_seen", F.col("updated_at")).withColumn("change", F.lit("")).limit(0)
        old = spark.read.schema(empty.schema).parquet(f"{state}/v{number - 1}") if number else empty
        kept = old.select(F.col("id").alias("_id"), F.col("updated_at").alias("_at"))
        rows = rows.join(kept, F.col("id") == F.col("_id"), "left").where("_at is null or updated_at >= _at").drop("_id", "_at")
        new = detect_changes(rows, old, F.col("updated_at"))
        old.join(new.select("id"), "id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{state}/v{number}")
        remove(f"{state}/v{number - keep}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and event type; works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
