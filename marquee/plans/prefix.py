"""Ranks and running sums over a whole table, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.staging import staged


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: each row's place (from 0) in the order given.

    The rows are range-partitioned and written, so the split into partitions is fixed;
    only one count for each partition meets in one task.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rank")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, "_part").withColumn(name, F.col("_before") + within - 1).drop("_part", "_before")


def running(df: DataFrame, key: str, order: list[Column], **sums: Column) -> DataFrame:
    """Adds each of ``sums`` as a running total (the row included) over the rows of ``key``, in the order given.

    Rows are range-partitioned by key and order and written, so a key with a third of all rows lies in
    many tasks. A partition goes on with one key of those before it at most; what that key had before is
    broadcast, a row a partition. Null keys have totals of their own.
    """
    ranged = staged(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), "running")
    parts = ranged.groupBy("_part", F.col(key).alias("_key")).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_part").alias("_at"), "_key", F.sum("_rows").over(before).alias("_rows"), *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    carried = carried.where("_rows is not null").drop("_rows")
    within = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.select("*", *[F.sum(c).over(within).alias(f"_own_{n}") for n, c in sums.items()])
    found = rows.join(F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_own_{n}") + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums])
