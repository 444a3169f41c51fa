"""Tables and files written to the folder that all executors share.

A staged table cuts lineage: what follows reads written Parquet, so a lost executor
costs its running tasks and nothing before them. Every call writes below a folder of
its own in the directory that ``spark.checkpoint.dir`` names. While a table is written
Spark is told to delete that job's shuffle files at its end: nothing reads them again.
``discard`` deletes a staged table whose readers have been written themselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marquee.plans.files import remove

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, else the checkpoint folder that the caller set.

    Where neither is set a local folder serves a local master; on a cluster it raises
    ``ValueError``, since a machine's own folder is lost to the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "marquee-shared")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/") if "://" in path or path.startswith("file:/") else "file://" + os.path.abspath(path)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marquee-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``staged`` wrote; nothing may read them afterwards. Other tables are left alone."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            remove(path)
            df.staged_at = None
