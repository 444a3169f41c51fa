"""State by key in deltas: a batch writes its own rows, reading merges, a rule compacts.

A batch's rows are put into ``deltas/batch=n`` by bucket (hash of the id); nothing else is
written for it, and of the state it reads only the buckets that its ids fall in. The state is the newest row
of each id over the last base and the deltas after it. After ``every`` deltas the state is written as a new base; bases and deltas that
the last but one base covers are then deleted, so a reader that began before a compaction can end.

A batch is known by its number: put again it replaces its own delta, and the same state comes out.
Defined cases: a row older by ``updated_at`` than the one kept changes nothing; of equally old ones the later batch's counts, within a batch
the one with the smaller hash; a null id is an id of its own; a null ``updated_at`` is older than any, and then first_seen is null; an empty batch writes no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from marquee.operators.changes import detect_changes
from marquee.operators.stats import latest
from marquee.plans.files import folders, remove

BUCKETS = 64


def _bucket(id: Column) -> Column:
    return F.pmod(F.xxhash64(id.cast("string")), F.lit(BUCKETS)).cast("int")


class KeyedState:
    """The state below ``path`` of rows with id, hash and updated_at; change and first_seen are added to them."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, every: int = 10) -> None:
        self.spark, self.path, self.every = spark, path, every
        self.schema = StructType([f for f in schema.fields if f.name not in ("change", "first_seen")] + [StructField("first_seen", TimestampType()), StructField("change", StringType())])

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the finished tables of a kind."""
        return sorted(int(f.split("=")[1]) for f in folders(f"{self.path}/{kind}", marked=True) if f.startswith(name + "="))

    def _table(self, kind: str, name: str, number: int) -> DataFrame:
        stored = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(stored).parquet(f"{self.path}/{kind}/{name}={number}").withColumn("batch", F.lit(number).cast("long"))

    def _parts(self, before: int | None) -> DataFrame:
        """All stored rows of the last base and the deltas after it, with bucket and batch; of batches before ``before``."""
        known = lambda n: before is None or n < before
        base = max(filter(known, self._numbers("base", "version")), default=None)
        deltas = [n for n in self._numbers("deltas", "batch") if known(n) and (base is None or n > base)]
        parts = [self._table("deltas", "batch", n) for n in deltas] + ([self._table("base", "version", base)] if base is not None else [])
        if not parts:
            return self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("bucket", IntegerType()), StructField("batch", LongType())]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rows(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each id."""
        parts = self._parts(before)
        if buckets is not None:  # folders of other buckets are not read
            parts = parts.where(F.col("bucket").isin(buckets))
        fields = [f.name for f in self.schema.fields]
        # equal times: the later batch; a row is a struct, so one aggregate with partial sums of work merges them
        age = F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62))), "batch")
        return parts.groupBy("bucket", "id").agg(F.max_by(F.struct(*fields), age).alias("_r")).select("_r.*")

    def put(self, batch: DataFrame, number: int) -> None:
        """Adds a batch of rows under its number, and compacts where it is time."""
        rows = latest(batch.select([f.name for f in self.schema.fields[:-2]]), "id", "updated_at", "hash").withColumn("bucket", _bucket(F.col("id")))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        old = self.rows(number, touched)
        kept = old.select(F.col("id").alias("_id"), F.col("updated_at").alias("_at"))
        newer = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")), "left").where("_id is null or _at is null or updated_at >= _at").drop("_id", "_at")
        changed = detect_changes(newer, old, F.col("updated_at"))
        changed.select(*[f.name for f in self.schema.fields], "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/batch={number}")
        bases = self._numbers("base", "version")
        if len([n for n in self._numbers("deltas", "batch") if not bases or n > bases[-1]]) >= self.every:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Writes the state up to batch ``number`` as a base; deletes what the base before the last covers."""
        whole = self.rows(number + 1).withColumn("bucket", _bucket(F.col("id")))
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={number}")
        bases = self._numbers("base", "version")
        if len(bases) > 1:
            for n in self._numbers("deltas", "batch"):
                if n <= bases[-2]:
                    remove(f"{self.path}/deltas/batch={n}")
            for n in bases[:-2]:
                remove(f"{self.path}/base/version={n}")


def ingest_deltas(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Reads new JSON files under ``source`` and puts them into the ``KeyedState`` at ``state``, a batch at a time."""
    stream = spark.readStream.schema(schema).json(source)
    kept = KeyedState(spark, state, stream.schema, every)
    return stream.writeStream.foreachBatch(kept.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
