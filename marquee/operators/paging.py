"""Deep pages: a sorted layout with its counts, read where the page lies.

``laid_out`` writes rows in order, a folder a range, and beside them a table of ranges: how many rows each
has, how many lie before it, and its last key. A page by number reads the one or two ranges that hold its
places; a page after a token (the key of the row before) reads the range of that key and what follows until
the page is full. Neither depends on how deep the page lies; the table of ranges has a row a range.

Defined cases: rows are ordered by the columns given, which should tell all rows apart (equal rows are interchangeable), nulls
first where ascending; a page past the end, or of an empty table, is empty.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marquee.plans.staging import new_path


@dataclasses.dataclass(frozen=True)
class Layout:
    """Where sorted rows lie, their order (columns with whether they descend) and their schema."""

    path: str
    order: tuple[tuple[str, bool], ...]
    schema: StructType

    def keys(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in self.order]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField("_range", IntegerType())])).parquet(f"{self.path}/rows")

    def ranges(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/ranges")


def laid_out(rows: DataFrame, order: list[tuple[str, bool]], ranges: int, path: str | None = None) -> Layout:
    """Writes ``rows`` in order into about ``ranges`` folders."""
    spark = rows.sparkSession
    layout = Layout(path or new_path(spark, "pages"), tuple(order), rows.schema)
    sorted_ = rows.repartitionByRange(ranges, *layout.keys()).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *layout.keys())
    sorted_.write.partitionBy("_range").parquet(f"{layout.path}/rows")
    back = layout.rows(spark)
    place = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    last = F.max_by(F.struct(*[c for c, _ in order]), F.struct(*_rising(back, layout)))
    counts = back.groupBy("_range").agg(F.count("*").alias("n"), last.alias("last"))
    counts.select("_range", "n", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("before"), "last").coalesce(1).write.parquet(f"{layout.path}/ranges")
    return layout


def _rising(df: DataFrame, layout: Layout) -> list[Column]:
    """Expressions that rise with the order; only numbers, dates and times can descend in them."""
    kinds = dict(df.dtypes)
    down = lambda c: -(F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith(("timestamp", "date")) else F.col(c))
    return [down(c) if d else F.col(c) for c, d in layout.order]


def page_at(spark: SparkSession, layout: Layout, page: int, limit: int) -> DataFrame:
    """The rows of ``page`` (from 1)."""
    first = (page - 1) * limit
    at = layout.ranges(spark).where((F.col("before") < first + limit) & (F.col("before") + F.col("n") > first)).select("_range", "before").collect()
    rows = layout.rows(spark).where(F.col("_range").isin([r["_range"] for r in at]))
    return rows.orderBy(*layout.keys()).offset(first - min((r.before for r in at), default=first)).limit(limit).drop("_range")


def token(row, layout: Layout) -> str:
    """What stands for the place after ``row``."""
    return json.dumps([None if row[c] is None else str(row[c]) for c, _ in layout.order])


def page_after(spark: SparkSession, layout: Layout, after: str, limit: int) -> DataFrame:
    """The ``limit`` rows after the one whose ``token`` is given, whether that row is still there or not."""
    rows = layout.rows(spark)
    kinds = dict(rows.dtypes)
    values = [F.lit(v).cast(kinds[c]) for (c, _), v in zip(layout.order, json.loads(after), strict=True)]

    def beyond(of) -> Column:
        """Whether a row's key comes after the token's."""
        test = F.lit(False)
        for (c, down), v in reversed(list(zip(layout.order, values, strict=True))):
            x = of(c)
            later = (x < v) if down else (x > v)
            later = F.coalesce(later, (v.isNotNull() & x.isNull()) if down else (v.isNull() & x.isNotNull()))
            test = later | (x.eqNullSafe(v) & test)
        return test

    ranges = layout.ranges(spark).where(beyond(lambda c: F.col("last").getField(c))).orderBy("_range")
    full = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # the first range holds the token's place, the ranges after it count in full
    first = ranges.limit(1).collect()
    if not first:
        return rows.limit(0).drop("_range")
    rest = ranges.where(F.col("_range") > first[0]["_range"]).select("_range", F.coalesce(F.sum("n").over(full), F.lit(0)).alias("so_far"))
    wanted = [first[0]["_range"], *[r["_range"] for r in rest.where(F.col("so_far") < limit).collect()]]
    return rows.where(F.col("_range").isin(wanted) & beyond(F.col)).orderBy(*layout.keys()).limit(limit).drop("_range")
