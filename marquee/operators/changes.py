"""Change capture between snapshots, upsert, patch and delete.

Defined cases: keys are unique in a snapshot; a null key equals no other, so its row is new, added or removed.
A null hash equals a null one. Empty tables count as snapshots without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, previous: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """``current`` with change (new, updated, unchanged) and first_seen, carried over from ``previous``."""
    old = previous.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"), F.col("first_seen").alias("_first"))
    joined = current.join(old, current[key] == F.col("_key"), "left")
    change = F.when(F.col("_key").isNull(), "new").when(~F.col("_hash").eqNullSafe(F.col("hash")), "updated").otherwise("unchanged")
    return joined.withColumn("change", change).withColumn("first_seen", F.coalesce("_first", as_of)).drop("_key", "_hash", "_first")


def diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, change: added, removed, updated or unchanged, by a full outer join of key and hash."""
    a, b = old.select(F.col(key).alias("_a"), F.col("hash").alias("_x")), new.select(F.col(key).alias("_b"), F.col("hash").alias("_y"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "unchanged").otherwise("updated")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def upsert(base: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the batch's rows put in by key; created_at stays the first one."""
    first = base.select(F.col(key).alias("_key"), F.col("created_at").alias("_created"))
    put = batch.join(first, batch[key] == F.col("_key"), "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_key", "_created")
    return base.join(batch.select(key), key, "left_anti").unionByName(put)


def patch(base: DataFrame, changes: DataFrame, key: str = "id", as_of: Column | None = None) -> DataFrame:
    """``base`` with the values of ``changes`` that aren't null; where ``as_of`` is given it is the updated_at of every row that is named there, whatever the change says."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, F.lit(True).alias("_named"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = base.join(renamed, key, "left")
    new = {c: F.coalesce(f"_{c}", c) for c in fields}
    if as_of is not None:
        new["updated_at"] = F.when(F.col("_named"), as_of).otherwise(F.col("updated_at"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def insert_new(base: DataFrame, batch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """An unordered bulk insert under a unique key: ``base`` with the rows of ``batch`` whose key it lacks, one a key, and the rows that are refused.

    Of rows with one key the first by a hash of all columns goes in; null keys are one key.
    """
    numbered = batch.withColumn("_no", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*batch.columns))))
    known = base.select(F.col(key).alias("_key")).distinct()
    marked = numbered.join(known.withColumn("_there", F.lit(True)), F.col(key).eqNullSafe(F.col("_key")), "left")
    refused = F.col("_there").isNotNull() | (F.col("_no") > 1)
    return base.unionByName(marked.where(~refused).select(*base.columns)), marked.where(refused).select(*batch.columns)


def flattened(groups: DataFrame, rows: str = "rows") -> DataFrame:
    """The rows of groups (an array of structs) again, one below the other."""
    return groups.select(F.inline(rows))


def from_pages(pages: DataFrame, number: str = "page", rows: str = "data", total: str = "total") -> tuple[DataFrame, DataFrame]:
    """The rows of an API's pages in order of page and place (columns page, place), and the total that the first page gives."""
    out = pages.select(F.col(number).alias("page"), F.posexplode(rows).alias("place", "_r")).select("page", "place", "_r.*")
    return out, pages.agg(F.min_by(total, number).alias("total"))


def delete(base: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def in_order(changed: DataFrame) -> DataFrame:
    """Changed rows with ``ord``: new ones, then updated ones, then the others."""
    return changed.withColumn("ord", F.array_position(F.array(*map(F.lit, ("new", "updated", "unchanged"))), F.col("change")).cast("int"))


def put_configs(old: DataFrame, new: DataFrame, as_of: Column, key: str = "source_id") -> DataFrame:
    """key, hash, outcome (inserted, updated, unchanged or kept) and imported_at, which stays that of the first import."""
    a, b = old.select(F.col(key).alias("_a"), F.col("hash").alias("_x"), F.col("imported_at").alias("_at")), new.select(F.col(key).alias("_b"), F.col("hash").alias("_y"))
    outcome = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "kept").when(F.col("_x").eqNullSafe(F.col("_y")), "unchanged").otherwise("updated")
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return both.select(F.coalesce("_b", "_a").alias(key), F.coalesce("_y", "_x").alias("hash"), outcome.alias("outcome"), F.coalesce("_at", as_of).alias("imported_at"))
