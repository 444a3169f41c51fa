"""Sources and their jobs: trust, counts before and after, health.

Defined cases: a null source is trusted as an unknown one and is in no count that joins two tables; a job that never
ran is healthy unless its status is error; empty tables give empty results, or one row of zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the trust from which a source's data of a kind are used; 50 for other kinds
TRUST_FOR = {"pricing": 80, "dates": 50, "venue": 60, "artists": 40, "metadata": 30}


def trusted_for(trust: Column, kind: str) -> Column:
    return trust >= TRUST_FOR.get(kind, 50)


def most_trusted(rows: DataFrame, group: str, trust: Column) -> DataFrame:
    """The row of each group with the highest trust; ties to the earliest updated_at, then ``ord``."""
    order = Window.partitionBy(group).orderBy(F.desc("_trust"), "updated_at", "ord")
    return rows.withColumn("_trust", trust).withColumn("_no", F.row_number().over(order)).where("_no = 1").drop("_no", "_trust")


def source_metadata(rows: DataFrame, group: str, trust: Column) -> DataFrame:
    """group, sources (sorted), primary_source (most trusted, then by ``ord``), n, scores (map).

    One row a group and source meets in a task, so groups of any size are bounded by the number of sources.
    """
    each = rows.withColumn("_t", trust).groupBy(group, "source").agg(F.max("_t").alias("_t"), F.min("ord").alias("_o"), F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("source", "_t")))
    out = each.groupBy(group).agg(entries.alias("_e"), F.min_by("source", F.struct(-F.col("_t"), "_o")).alias("primary_source"), F.sum("_n").alias("n"))
    return out.select(group, F.transform("_e", lambda e: e["source"]).alias("sources"), "primary_source", "n", F.map_from_entries("_e").alias("scores"))


def source_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, n_before, n_after, removed; a source missing on one side counts 0."""
    a, b = (d.groupBy("source").agg(F.count("*").alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, "source", "full_outer").select("source", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.withColumn("removed", F.col("n_before") - F.col("n_after"))


def job_states(jobs: DataFrame, as_of: Column) -> DataFrame:
    """``jobs`` (status, last_run) with state: error, stuck (running over 30 minutes), stale (over 24 hours) or healthy."""
    since = lambda hours: F.col("last_run") < as_of - F.expr(f"INTERVAL {hours} MINUTES")
    state = F.when(F.col("status") == "error", "error").when((F.col("status") == "running") & since(30), "stuck").when(since(24 * 60), "stale").otherwise("healthy")
    return jobs.withColumn("state", state)


def job_summary(jobs: DataFrame, as_of: Column) -> DataFrame:
    """total and the number of jobs in each state."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return job_states(jobs, as_of).agg(F.count("*").alias("total"), n("healthy"), n("error"), n("stuck"), n("stale"))


def overall_health(summary: DataFrame) -> DataFrame:
    """overall, over the states of a run summary: healthy without failed and with at most one degraded source, degraded up to two failed, else critical."""
    failed, degraded = F.count_if(F.col("state") == "failed"), F.count_if(F.col("state") == "degraded")
    return summary.agg(F.when((failed == 0) & (degraded <= 1), "healthy").when(failed <= 2, "degraded").otherwise("critical").alias("overall"))
