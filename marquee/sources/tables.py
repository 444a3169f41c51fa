"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; Spark alone opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
