"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0 to N - 1 in the order of doc_id (``global_rank``: range-partitioned, one count
a partition meets in one task). A number is split into two digits of radixes whose product
is N or little more; in each half round one digit is moved by a keyed function of the other (an
unbalanced Feistel network, so a permutation of all digit pairs). A result of N or more is
permuted again until it is below N. The place p that comes out gives shard ``p % shards`` and slot
``p // shards``: counts differ by one at most, slots have no gaps, and the law is ``rows``. Place,
shard and slot of a row number, and the row number at a shard and slot, are computed from the
numbers alone (``permuted``, ``row_number_at``), so any reader finds any row without a table.

A walk meets each number of the surplus once at most, so it ends within surplus + 1
steps; radixes are chosen so that the surplus is small. Everything is integer arithmetic in
DataFrame expressions; round functions cube modulo a prime, whose squares fit in a long.

Defined cases: a null text has 0 bytes; null doc_ids come first; rows with equal doc_id are ordered by a hash of
all their columns that can be hashed (no maps), so reruns agree but for equal rows, which are interchangeable; repeated
rows each have a place; equal texts are dealt as any other rows; an empty table gives an empty
result; a column of the caller's named like one that is added is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from marquee.plans.prefix import global_rank
from marquee.plans.staging import discard, staged

#: Modulus of the round functions, a prime.
PRIME = 2147483647
#: Full rounds; each moves both digits.
ROUNDS = 3
#: Radixes tried below the square root.
TRIED = 512


def radixes(rows: int) -> tuple[int, int]:
    """Two radixes of about the square root whose product exceeds ``rows`` least (the larger first radix among equals)."""
    root = max(1, math.isqrt(rows))
    best = min(range(max(root // 2 + 1, root - TRIED + 1), root + 1), key=lambda a: (-(-rows // a) * a - rows, -a))
    return best, max(1, -(-rows // best))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two keys a round, by a multiplicative generator modulo ``PRIME``."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(2 * ROUNDS):
        x = x * 48271 % PRIME
        keys.append(x)
    return list(zip(keys[::2], keys[1::2], strict=True))


def _cube(x: Column, key: Column) -> Column:
    t = (x + key) % F.lit(PRIME).cast("long")
    return t * t % F.lit(PRIME).cast("long") * t % F.lit(PRIME).cast("long")


def _div(x: Column, by: Column) -> Column:
    """The whole quotient of longs."""
    return F.call_function("div", x, by)


def _once(number: Column, rows: int, seed: int, back: bool = False) -> Column:
    """One pass of the network (or of its inverse) over the digit pairs."""
    a, b = (F.lit(x).cast("long") for x in radixes(rows))
    pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    keys = round_keys(seed)

    def forth(at: Column, key: Column) -> Column:
        x = (at["x"] + _cube(at["y"], key["x"])) % a
        return pair(x, (at["y"] + _cube(x, key["y"])) % b)

    def again(at: Column, key: Column) -> Column:
        y = F.pmod(at["y"] - _cube(at["x"], key["y"]), b)
        return pair(F.pmod(at["x"] - _cube(y, key["x"]), a), y)

    steps = F.array(*[pair(F.lit(i), F.lit(j)) for i, j in (keys[::-1] if back else keys)])
    start = pair(_div(number, b), number % b)
    return F.aggregate(steps, start, again if back else forth, lambda at: at["x"] * b + at["y"])


def permuted(number: Column, rows: int, seed: int, back: bool = False) -> Column:
    """The place of row ``number`` (0 to ``rows`` - 1) in the shuffle, or with ``back`` the row number at a place."""
    a, b = radixes(rows)
    surplus = a * b - rows
    first = F.array(_once(number, rows, seed, back))
    if not surplus:
        return first[0]
    step = lambda p, _: F.when(p < rows, p).otherwise(_once(p, rows, seed, back))
    walk = lambda p: F.aggregate(F.when(p < rows, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(surplus))), p, step)
    return F.transform(first, walk)[0]


def row_number_at(shard: Column, slot: Column, rows: int, shards: int, seed: int) -> Column:
    """The row number that lies at ``slot`` of ``shard``."""
    return permuted((slot * shards + shard).cast("long"), rows, seed, back=True)


def _hashed(kind: DataType) -> bool:
    return not any(isinstance(x, MapType | VariantType) for x in _within(kind))


def _within(kind: DataType) -> list[DataType]:
    inner = [f.dataType for f in kind.fields] if hasattr(kind, "fields") else [kind.elementType] if hasattr(kind, "elementType") else []
    return [kind, *(x for k in inner for x in _within(k))]


def sharded(docs: DataFrame, shards: int = 24, seed: int = 13, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, where None) and size, text_crc32, law, shard, slot, grown_shard (null), row_number (from 0)."""
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new]
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if _hashed(f.dataType)])
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = [F.col("doc_id").alias("_id"), content.alias("_content"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(True)
    # written first, so that the last column of the order stays as it is whenever a task is repeated
    rows = staged(docs.select(row.alias("row"), *own, F.monotonically_increasing_id().alias("_tie")), "sizes")
    n = rows.count()
    ranked = global_rank(rows, [F.col("_id").asc_nulls_first(), F.col("_content"), F.col("_tie")], "row_number")
    discard(rows)
    placed = ranked.withColumn("_place", permuted(F.col("row_number").cast("long"), n, seed))
    count = F.lit(shards).cast("long")
    shard, slot = (F.col("_place") % count).cast("int"), _div(F.col("_place"), count)
    own = [F.col("size"), F.col("text_crc32"), F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("row_number").cast("long")]
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], *own)


def write_shards(rows: DataFrame, path: str, files: int) -> None:
    """Writes ``sharded`` rows below ``path`` in a folder a shard, in the order of slots; a file holds a range of slots, so no task holds a shard."""
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
