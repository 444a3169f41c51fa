"""Summaries of sources, runs and health, and window-like operators.

Defined cases: a null source, key or group is one of its own; a row without a start
counts as past; ties in an order are settled by the columns named, else rows are interchangeable; empty tables
give empty results, or one row of zero counts where all rows are summed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.prefix import global_rank
from marquee.plans.staging import staged


def by_source(listings: DataFrame, as_of: Column) -> DataFrame:
    """source, total, upcoming, past, last_update."""
    upcoming = F.count_if(F.col("date_start") >= as_of)
    return listings.groupBy("source").agg(F.count("*").alias("total"), upcoming.alias("upcoming"), (F.count("*") - upcoming).alias("past"), F.max("updated_at").alias("last_update"))


def detailed(rows: DataFrame) -> DataFrame:
    """source (null: all), total, new, updated, unchanged, by rollup."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return rows.rollup("source").agg(F.count("*").alias("total"), n("new"), n("updated"), n("unchanged"))


def run_summary(runs: DataFrame) -> DataFrame:
    """source, runs, failed, success_rate (2 decimals), total_ms, state."""
    out = runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failed"), F.round(F.sum("duration_ms"), 4).alias("total_ms"))
    rate = F.when(F.col("runs") > 0, F.round(100.0 * (F.col("runs") - F.col("failed")) / F.col("runs"), 2)).otherwise(0.0)
    state = F.when(F.col("runs") - F.col("failed") >= 2, "healthy").when(F.col("runs") - F.col("failed") >= 1, "degraded").otherwise("failed")
    return out.withColumn("success_rate", rate).withColumn("state", state)


def latest(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(when), tie)
    return rows.withColumn("_no", F.row_number().over(order)).where("_no = 1").drop("_no")


def top_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def fill_forward(rows: DataFrame, key: str, order: str, header: Column, name: str) -> DataFrame:
    """``name``: the last header at or before each row in ``order``; rows before their key's first one go.

    Rows are dealt by ranges of key and order, so a key of any size spans many tasks; the last header of
    each range is carried into the next ones, one row a key and range.
    """
    ranged = staged(rows.withColumn(name, header).repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_at", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn(name, F.last(name, ignorenulls=True).over(within))
    both = own.join(carried, own[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left").withColumn(name, F.coalesce(name, "_carried"))
    return both.where(F.col(name).isNotNull()).drop("_part", "_key", "_at", "_carried")


def requests_within(rows: DataFrame, key: str, seconds: Column, span: int) -> DataFrame:
    """``n_within``: rows of the key in the last ``span`` seconds, this one included.

    A key is cut into pieces of ``span`` seconds; each row also visits the piece after its own, so all that it may be
    counted in lies in one piece.
    """
    frame = Window.partitionBy(key, "_piece").orderBy("_s").rangeBetween(-span, 0)
    cut = rows.withColumn("_s", seconds).withColumn("_visits", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_piece", F.floor(F.col("_s") / span) + F.col("_visits"))
    return cut.withColumn("n_within", F.count("*").over(frame)).where("_visits = 0").drop("_s", "_visits", "_piece")


def by_day(listings: DataFrame) -> DataFrame:
    """day (date-tba without date), n, first and last id in order of time."""
    day = F.coalesce(F.date_format("date_start", "yyyy-MM-dd"), F.lit("date-tba"))
    return listings.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min_by("id", F.struct("date_start", "id")).alias("first_id"), F.max_by("id", F.struct("date_start", "id")).alias("last_id"))


def last_update(rows: DataFrame, as_of: Column) -> DataFrame:
    """The newest updated_at of all rows; ``as_of`` where there is none."""
    return rows.agg(F.coalesce(F.max("updated_at"), as_of).alias("last_update"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table, counted in one job."""
    parts = [t.select(F.lit(n).alias("name")) for n, t in tables.items()]
    names = parts[0].sparkSession.createDataFrame([(n,) for n in tables], "name string")
    found = reduce(DataFrame.union, parts).groupBy("name").agg(F.count("*").alias("_n"))
    return names.join(found, "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


def first_update_by_source(rows: DataFrame, order: str) -> DataFrame:
    """source, n and updated_at of each source's first row in ``order``, not the newest."""
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min_by("updated_at", order).alias("first_update"))


def with_counts(stats: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """``stats`` (a row a source) with ``columns`` of ``other``, 0 where that has no row; sources only ``other`` has are left out."""
    found = other.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in columns])
    return stats.join(found, F.col("source") == F.col("_source"), "left").select(*stats.columns, *[F.coalesce(f"_{c}", F.lit(0)).alias(c) for c in columns])


def hit_rates(requests: DataFrame, key: str, hit: Column) -> DataFrame:
    """key (null: all), requests, hits, misses and hit_rate (2 decimals, 0 without requests), by rollup."""
    sums = requests.rollup(key).agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"))
    rate = F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests"), 2)).otherwise(0.0)
    return sums.withColumn("misses", F.col("requests") - F.col("hits")).withColumn("hit_rate", rate)


def rate_limited(requests: DataFrame, key: str, ts: str, tie: str, per_minute: int = 100, per_second: int = 10) -> DataFrame:
    """``requests`` with in_minute, in_second (place of the request in its key's minute and second) and allowed: neither above its limit.

    Minutes and seconds are those of the clock, so a key's rows are cut into many groups.
    """
    place = lambda unit: F.row_number().over(Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(ts, tie))
    out = requests.withColumns({"in_minute": place("MINUTE"), "in_second": place("SECOND")})
    return out.withColumn("allowed", (F.col("in_minute") <= per_minute) & (F.col("in_second") <= per_second))


def day_order(rows: DataFrame, order: str) -> DataFrame:
    """day and n, with ``place``: the days in the order in which ``rows`` first name them."""
    day = F.coalesce(F.date_format("date_start", "yyyy-MM-dd"), F.lit("date-tba"))
    days = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return global_rank(days, [F.col("_first"), F.col("day")], "place").drop("_first")


def samples(rows: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """group, the first ``n`` titles, the first venue, and first and last day as one text."""
    first = rows.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_p") <= n)
    titles = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "title"))), lambda x: x["title"]).alias("titles"), F.min_by("venue", "_p").alias("venue"))
    day = lambda f: F.date_format(f("date_start"), "yyyy-MM-dd")
    spans = rows.groupBy(group).agg(F.concat_ws(" to ", day(F.min), day(F.max)).alias("days"))
    return titles.join(spans, group)
