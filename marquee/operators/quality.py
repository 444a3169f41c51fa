"""Validation: a row gets the list of what is wrong with it, and sanitised values.

Defined cases: null and blank texts are missing; a null price is none and no error; repeated rows are judged alike;
an empty table gives an empty result. ``validation`` checks whole records field by field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("scheduled", "cancelled", "postponed")


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` with errors (array, in a fixed order) and is_valid."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    checks = [F.when(empty(c), F.lit(f"missing {c}")) for c in ("id", "source", "title", "venue")]
    checks += [F.when(F.col("date_start").isNull(), F.lit("bad date_start")), F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("bad status")), F.when(F.col("price") < 0, F.lit("negative price"))]
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("is_valid", F.size("errors") == 0)


def sanitised(rows: DataFrame) -> DataFrame:
    """Trimmed texts, tags without empty and repeated ones, a known status, no negative price."""
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != ""))
    return rows.withColumns({"title": F.trim("title"), "venue": F.trim("venue"), "tags": tags, "status": F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("scheduled"), "price": F.when(F.col("price") >= 0, F.col("price"))})


def tally(rows: DataFrame) -> DataFrame:
    """source, valid, invalid, errors."""
    return validated(rows).groupBy("source").agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.sum(F.size("errors")).cast("long").alias("errors"))


def repeated_keys(rows: DataFrame, key: str = "id") -> DataFrame:
    """``key`` and n of the keys that more than one row has (null is a key): none where a unique index would hold."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
