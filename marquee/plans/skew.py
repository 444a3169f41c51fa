"""Joins that hold when one key has a third of all rows, and filters ahead of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.staging import staged

#: A key is heavy above this share of all rows, so at most so many keys are heavy.
HEAVY_KEYS = 1_000
#: Bits of a filter: 8 MiB at most, in rows of 4 KiB.
FILTER_BITS = 1 << 26


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", keys: int = HEAVY_KEYS) -> DataFrame:
    """``rows`` joined with ``table``, a written table of one row a key with the rows of that key in ``weight``.

    Heavy keys, those with more than one row in ``keys`` and so fewer than ``keys``, are broadcast, so their rows stay where they are; all
    other keys are shuffled. ``how`` is inner or left. A null key finds nothing.
    """
    total, top = table.agg(F.sum(weight), F.max(weight)).first()
    plain = table.drop(weight)
    if not total or top * keys <= total:
        return rows.join(plain, on, how)
    heavy = table.where(F.col(weight) * keys > total).drop(weight)
    found = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(plain, on, how)
    return found.unionByName(rest.select(*found.columns))


def may_be_in(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """``rows`` with a column that is false only where ``key`` isn't in ``wanted`` (one long column).

    Returns the rows, the condition and the columns to drop afterwards. A bit stands for each hash
    of a wanted key; the bitmap has ``FILTER_BITS`` bits whatever the tables' size, so it is
    broadcast. More wanted keys let more rows through, never fewer.
    """
    place = lambda x: F.pmod(F.xxhash64(F.lit(17), x), F.lit(FILTER_BITS))
    at = wanted.select(place(F.col(wanted.columns[0])).alias("_at"))
    bitmap = at.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    out = rows.withColumn("_at", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    out = out.join(F.broadcast(bitmap), "_bucket", "left")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return out, on, ["_at", "_bucket", "_bits"]


def once_each(rows: DataFrame, on: str, **made: Column) -> DataFrame:
    """``rows`` with the columns ``made``, which are costly functions of the column ``on`` alone: each is worked out once for a value of it."""
    made = [c.alias(n) for n, c in made.items()]
    values = staged(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_rows")), "values")
    values = staged(values.repartition(on).select(on, "_rows", *made), "made")
    found = lookup(rows.where(F.col(on).isNotNull()), values, [on], "_rows")
    return found.unionByName(rows.where(F.col(on).isNull()).select("*", *made))
