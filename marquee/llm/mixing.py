"""Mix sources to target weights: hash-random keys, prefix sums, exact cuts.

Each source gets a word budget; its documents are ordered by a hash of their id, and
prefix sums over that order say which words lie below the budget. A budget above the
source's size takes whole epochs first. Only DataFrame functions run.

How it scales: the text is read once, for its size; all else moves narrow rows. A
source is cut into ranges of its (uniform) keys of about ``bucket_rows`` rows, so a hot
source spreads over many tasks, and only one sum for each range meets in one window.
Source totals stay a table; the driver gets four numbers a round.

Defined cases: a null text has size 0; null sources form one source, last in order;
a null id is hashed as an empty string; repeated ids stand next to each other and are
ordered by size and a hash of the text; an empty table gives an empty result; columns
other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.words import WORD, count_words
from marquee.plans.prefix import global_rank
from marquee.plans.rows import packed, unpacked
from marquee.plans.staging import staged


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size, n) with ``target`` words for each source.

    Sources in code-point order, null last, take ``weights`` in turn. ``share`` times all
    words is dealt by weight; a target stops at ``cap`` times its source's size and what
    it leaves is dealt again by weight, until no target is above.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight.cast("long")), "sources")
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, seen = share * (total or 0), 0.0, None
    at_cap = lambda x: F.col("source_size") * F.lit(cap) <= F.lit(x) * F.col("weight")
    while all_weight:
        capped = at_cap(level) if seen is not None else F.lit(False)
        fixed, free = ranked.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free or (fixed, free) == seen:
            break
        seen, level = (fixed, free), (budget - cap * (fixed or 0)) / free
    target = F.when(at_cap(level), F.col("source_size") * F.lit(cap)).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "n", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    bucket_rows: int = 2_000,
) -> DataFrame:
    """doc_id, source, tie, size, source_size, target, epochs, extra, taken for each row.

    ``epochs`` whole copies of the document are taken and the first ``extra`` words once
    more; ``taken`` counts the words of both. The words taken of a source are its target
    rounded down: the one document at the cut is taken in part.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, share, cap)
    t = targets.withColumnRenamed("source", "_source")
    parts = F.ceil(F.col("n") / bucket_rows)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = base.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", F.floor(place * parts).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).drop("_source", "_bucket")
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("size").over(run) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("_start", start).withColumn("epochs", epochs)
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_start")))
    rows = rows.withColumn("extra", extra).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    return rows.select("doc_id", "source", "tie", "size", "source_size", "target", "epochs", "extra", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, with the white space between."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy that is taken.

    Rows that are equal in id, source and text are dealt with as one group of copies; of their
    other columns those of the least row (as JSON) are given, so reruns agree.
    The document at a source's cut appears once with its first words only, and its
    ``n_chars``, if there is one, follows. Documents without words take no part.
    """
    taken = staged(mix(docs.select("doc_id", "source", "text"), **options).where("taken > 0"), "taken")
    ways = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int")), F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>")))
    copies = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), F.col("size").alias("_size"), F.explode(ways).alias("words"))
    key, same = ["doc_id", "source", "tie"], ["_id", "_source", "_tie", "_size"]
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64("text").alias("tie"))
    if not taken.groupBy(*key).count().where("count > 1").isEmpty():
        # equal rows would join each with each: the least of them stands for all and takes their copies
        copies = copies.groupBy(*same).agg(F.collect_list("words").alias("all"))
        rows = rows.groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    else:
        copies = copies.select(*same, F.array("words").alias("all"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("tie") == F.col("_tie"))
    rows = rows.join(copies, on).withColumn("words", F.explode("all"))
    part = (F.col("words") >= 0) & (F.col("words") < F.col("_size"))
    text = F.when(part, first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(rows, docs.columns, **new)
