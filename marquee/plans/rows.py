"""A caller's rows kept whole in one column, so that no name of theirs can clash with a working column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``docs`` as a struct column ``row``, with ``columns`` made from them beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns ``names`` of the packed rows again; those in ``new`` get these values where they exist."""
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names])
