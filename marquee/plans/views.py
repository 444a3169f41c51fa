"""Listings, snapshots and runs as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.tables import table

STATUS = {"O": "scheduled", "F": "cancelled", "P": "postponed"}


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """id, source, title, venue, city, country, date_start, status, price, updated_at."""
    t = lambda n: table(spark, sf, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    status = F.coalesce(*[F.when(F.col("o_orderstatus") == k, v) for k, v in STATUS.items()])
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("source"), F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"), F.col("c_name").alias("venue"), F.col("n_name").alias("city"),
        F.col("r_name").alias("country"), F.col("o_orderdate").alias("date_start"), status.alias("status"), F.col("o_totalprice").alias("price"), (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("updated_at"),
    )


def tagged(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """``listings`` (or those of them in ``of``) with tags: the distinct brands and types of an order's parts, sorted."""
    lines = table(spark, sf, "lineitem")
    if of is not None:  # only these orders' parts are joined and gathered
        lines = lines.join(of.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tags = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("p_brand", "p_type"))))).alias("tags"))
    return (listings(spark, sf) if of is None else of).join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def snapshot(spark: SparkSession, sf: str, new: bool) -> DataFrame:
    """id, source, price, hash, first_seen, created_at; a seventh of the ids is new, an eleventh gone, every fifth price differs."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    o = o.where(key % 11 != 0) if new else o.where(key % 7 != 0)
    price = F.when(key % 5 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")) if new else F.col("o_totalprice")
    rows = o.select(key.alias("id"), F.col("c_mktsegment").alias("source"), price.alias("price"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("created_at"))
    return rows.withColumn("hash", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.format_string("%.2f", "price")), 256))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """source, ts, success, duration_ms from the events."""
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), "ts", (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"), "event_id")
