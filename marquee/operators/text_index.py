"""Indexed text search: terms to bitmaps of row numbers, in files by hash of the term.

A row is numbered once, from 1, when it is added; numbers go on from batch to batch. A term's rows are bitmaps of
64 numbers each, one long (one row of the table for a term, a chunk of 64 numbers and a batch), so a rare term takes a few bytes
and a term that a third of all rows hold as many rows as there are chunks, made by partial aggregation in fixed buffers, never one list. Terms lie in ``parts`` folders by their hash
and in order within a file, so a search reads the folders of its terms, and there the row groups that may hold them. Terms are
joined (all or any) by aggregates of bitmaps, and so are the rows that a search finds: by chunk, with a look at the row's bit, so what a join may
broadcast is a row for 64 numbers.

Two kinds of terms: ``words`` (runs of letters, digits, ``_`` and ``#``), and ``grams``, all substrings of three
characters, for searches of any part of a text: rows that hold all of a text's grams are
candidates, which are then compared with the text itself.

Rows are written after their terms, and numbers are taken from the rows, so a failed addition is simply repeated; terms that it left then
stand for rows of the same numbers, which only adds candidates for ``containing``. One writer at a time.
Defined cases: case is ignored; null texts have no terms; a text of under three characters has no gram, so
such a search compares all rows; repeated rows are rows of their own; an index of an empty table finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marquee.plans.prefix import global_rank

#: Folders of terms.
PARTS = 64
GRAM = 3


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}#_]+"), lambda w: w != ""))


def grams(text: Column) -> Column:
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substr(low, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


KINDS = {"words": words, "grams": grams}


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException:  # nothing has been added
        return None


def add(rows: DataFrame, path: str, columns: list[str], kind: str, id: str = "id") -> None:
    """Adds ``rows`` (``id`` and texts or arrays of texts in ``columns``) to the index below ``path``, which is made with the first batch."""
    old = _rows(rows.sparkSession, path)
    batch, first = old.agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1, F.coalesce(F.max("number"), F.lit(0))).first() if old is not None else (0, 0)
    array = lambda c: dict(rows.dtypes)[c].startswith("array")
    texts = F.array_compact(F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) if array(c) else F.array(c) for c in columns])))
    numbered = global_rank(rows.select(F.col(id).alias("id"), texts.alias("texts")), [F.col("id"), F.xxhash64("texts")], "number")
    numbered = numbered.select((F.col("number") + first + 1).cast("long").alias("number"), "id", "texts")
    # texts are small and their terms many: a fixed number of tasks, each with whole runs of numbers
    spread = numbered.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, F.shiftright("number", 15))
    terms = spread.select("number", F.explode("texts").alias("text")).select("number", F.explode(KINDS[kind]("text")).alias("term"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(64)).cast("int"))
    bits = terms.groupBy("term", F.shiftright("number", 6).alias("chunk")).agg(F.bit_or(bit).alias("bits"))
    bits = bits.withColumn("part", _part(F.col("term"))).repartition("part", F.pmod(F.xxhash64(F.shiftright("chunk", 9)), F.lit(8))).sortWithinPartitions("part", "term", "chunk")
    bits.write.mode("append").partitionBy("part").parquet(f"{path}/terms/{kind}")
    numbered.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/rows")


def postings(spark: SparkSession, path: str, kind: str, terms: list[str]) -> DataFrame:
    """part, term, chunk, bits of the terms; reads their folders only."""
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t"))).distinct().collect()]
    return spark.read.parquet(f"{path}/terms/{kind}").where(F.col("part").isin(parts) & F.col("term").isin(terms))


def having(spark: SparkSession, path: str, kind: str, terms: list[str], all_of: bool = True) -> DataFrame:
    """chunk, bits of the rows that hold all of the terms, or any; one row for each chunk that has some."""
    found = postings(spark, path, kind, terms)
    if all_of:
        each = found.groupBy("chunk", "term").agg(F.bit_or("bits").alias("bits"))  # batches may share a chunk
        whole = each.groupBy("chunk").agg(F.count("*").alias("n"), F.bit_and("bits").alias("bits")).where((F.col("n") == len(set(terms))) & (F.col("bits") != 0))
    else:
        whole = found.groupBy("chunk").agg(F.bit_or("bits").alias("bits"))
    return whole.select("chunk", "bits")


def _found(spark: SparkSession, path: str, chunks: DataFrame | None) -> DataFrame:
    """id and texts of the rows in ``chunks``, which are joined as bitmaps: a term of all rows sends one row for 64 of them."""
    rows = _rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], "id long, texts array<string>")
    if chunks is None:
        return rows.select("id", "texts")
    numbered = rows.withColumn("chunk", F.shiftright("number", 6)).join(chunks, "chunk")
    return numbered.where(F.getbit("bits", F.pmod("number", F.lit(64)).cast("int")) == 1).select("id", "texts")


def containing(spark: SparkSession, path: str, text: str) -> DataFrame:
    """id and texts of the rows with a text that has ``text`` in it, by grams."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    chunks = having(spark, path, "grams", wanted) if wanted and _rows(spark, path) is not None else None
    return _found(spark, path, chunks).where(F.exists("texts", lambda t: F.contains(F.lower(t), F.lit(low))))


def with_words(spark: SparkSession, path: str, words_: list[str], all_of: bool = False) -> DataFrame:
    """id and texts of the rows that have one of the words, or all."""
    chunks = having(spark, path, "words", [w.lower() for w in words_], all_of) if _rows(spark, path) is not None else None
    return _found(spark, path, chunks)
