"""Scores of the pairs of a block, made where the block's rows meet: no pair is shuffled, only rows are.

A row goes to its blocks with all that scoring reads. Blocks of more than ``block_rows`` rows are cut: a task gets the rows of one
chunk, or of two. A pair is made in one of the blocks that it shares, the first in their order. Tasks hold a block (of two chunks at most) or a
component of at most ``GROUP_ROWS`` rows, and ``PAIRS`` pairs at once, as places of rows in arrays.

Three results: all scored pairs; links that connect what the links of a block connect, fewer than its rows; and greedy groups of whole
components. The last two score as few pairs as they can: a row that is connected, or taken, is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.similarity import Texts
from marquee.plans.skew import lookup
from marquee.plans.staging import staged

#: Pairs that a task holds at once, rows it gathers before it compares, and rows of a component that one task groups, at most.
PAIRS, ROWS, GROUP_ROWS = 1 << 17, 1 << 13, 5_000
#: How often rows are compared with one row of their group, before all pairs that are not connected yet.
TURNS = 4
#: Raw texts that reasons show.
SHOWN = ("venue", "title", "city")


@dataclass(frozen=True)
class Law:
    """What makes a confidence: weights of venue, title, place and date, and the hours that dates may differ."""

    weights: tuple[float, float, float, float]
    hours: int


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _by_group(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a group side by side in the order of ``_id``; ``_first`` marks a group's first row. Groups of one row are left out."""
    whole = Window.partitionBy(*group).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.repartition(_tasks(rows), *group).withColumn("_n", F.count("*").over(whole))
    placed = placed.withColumn("_first", F.row_number().over(Window.partitionBy(*group).orderBy("_id")) == 1)
    return placed.where("_n > 1").drop("_n", "_low", "_high", *group)


def blocked(forms: DataFrame, block_rows: int) -> DataFrame:
    """The rows of ``forms`` in each of their blocks (``keys``), sorted for ``_scored``; ``_before`` are the row's blocks before this one."""
    rows = forms.select("*", F.explode("keys").alias("_block"))
    # hashes are counted: two blocks of one hash are only cut sooner
    counts = rows.groupBy(F.xxhash64("_block").alias("_hash")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block_rows)
    large = staged(counts.withColumn("_parts", F.ceil(F.col("_rows") / block_rows).cast("int")), "blocks")
    whole = large.isEmpty()
    if whole:
        rows = rows.withColumns({"_chunk": F.lit(0), "_with": F.lit(0)})
    else:
        rows = lookup(rows.withColumn("_hash", F.xxhash64("_block")), large, ["_hash"], "_rows", "left").drop("_hash")
        parts = F.coalesce("_parts", F.lit(1))
        rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id"), parts).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    before = F.transform(F.filter("keys", lambda k: k < F.col("_block")), lambda k: F.xxhash64(k))
    rows = rows.withColumns({"_before": before, "_low": F.least("_chunk", "_with"), "_high": F.greatest("_chunk", "_with")})
    rows = rows.withColumns({"_own": F.col("_chunk") == F.col("_low"), "_alone": F.col("_low") == F.col("_high")})
    # constants among the keys would cost a second shuffle
    return _by_group(rows.drop("keys", "_chunk", "_with"), ["_block"] if whole else ["_block", "_low", "_high"])


def _least(threshold: float) -> float:
    """The smallest number that rounds (half up, to six places) to ``threshold`` or more."""
    return float(Decimal(repr(threshold)).quantize(Decimal("0.000001"), ROUND_CEILING) - Decimal("0.0000005"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """As Spark's ``round`` to six places: half up, of a number's shortest decimal form."""
    low = np.floor(x * 1e6)
    rest = x * 1e6 - low
    out = low + (rest > 0.5)
    for k in np.flatnonzero(np.abs(rest - 0.5) < 1e-4):
        out[k] = int((Decimal(repr(float(x[k]))) * 1_000_000 + Decimal("0.5")) // 1)
    return out / 1e6


def _longs(lists: pa.Array) -> np.ndarray:
    """Lists of longs as a matrix, filled up with 0."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(int(sizes.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


class _Rows:
    """The rows of whole groups, ready to be compared by their places."""

    def __init__(self, table: pa.Table, law: Law):
        column = lambda n: table[n].combine_chunks()
        number = lambda n: (column(n).fill_null(0).to_numpy(zero_copy_only=False), column(n).is_valid().to_numpy(zero_copy_only=False))
        self.table, self.law, self.n = table, law, table.num_rows
        self.ids = column("_id")
        self.id_code = self.ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.first = np.flatnonzero(column("_first").to_numpy(zero_copy_only=False))
        self.group = np.cumsum(column("_first").to_numpy(zero_copy_only=False)) - 1
        self.end = np.append(self.first[1:], self.n)[self.group]
        self.texts = {k: Texts(column(k)) for k in ("v", "t", "c", "p")}
        self.day, self.has_day = number("day")
        self.second, self.has_second = number("second")
        self.origin = column("origin").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def parts(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """Confidence (not rounded) of the pairs, and its parts."""
        like = {k: self.texts[k].likeness(i, j) for k in ("v", "t", "c")}
        cities = (self.texts["c"].at[i] >= 0) & (self.texts["c"].at[j] >= 0)
        place, other = like["c"], np.flatnonzero(~cities)
        if len(other):
            place[other] = self.texts["p"].likeness(i[other], j[other])
        same_day = (self.day[i] == self.day[j]) & self.has_day[i] & self.has_day[j]
        within = (np.abs(self.second[i] - self.second[j]) <= self.law.hours * 3600) & self.has_second[i] & self.has_second[j]
        date = np.where(same_day, 1.0, np.where(within, 0.8, 0.0))
        overall = np.zeros(len(i))
        for w, part in zip(self.law.weights, (like["v"], like["t"], place, date), strict=True):
            overall = overall + w * part
        same_source = (self.origin[i] == self.origin[j]) & (self.origin[i] >= 0)
        return {"overall": np.where(same_source, 1.0, overall), "venue": like["v"], "title": like["t"], "place": place, "cities": cities, "same_day": same_day, "within": within, "same_source": same_source}

    def pairs(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of each pair that is to be made in these groups (those ``wanted``), ``PAIRS`` and a row's at once."""
        later = self.end - np.arange(self.n) - 1
        if wanted is not None:
            later[~wanted[self.group]] = 0
        upto, at = np.cumsum(later), 0
        before = _longs(self.table["_before"].combine_chunks())
        own, alone = (self.table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_own", "_alone"))
        while at < self.n:
            stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)), at + 1)
            count = later[at:stop]
            i = np.repeat(np.arange(at, stop), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            keep = (self.id_code[i] != self.id_code[j]) & (alone[i] | (own[i] != own[j]))
            for p in range(before.shape[1]):
                for q in range(before.shape[1]):
                    keep &= (before[i, p] != before[j, q]) | (before[i, p] == 0)
            at = stop
            if keep.any():
                yield i[keep], j[keep]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``ROWS`` rows or more where there are so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(table["_first"].to_numpy())
        if starts[-1]:
            yield table.slice(0, starts[-1])
        held = table.slice(starts[-1]).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def scored(blocks: DataFrame, law: Law, least: float = 0.0, shown: bool = False) -> DataFrame:
    """a, b, confidence, same_day of the pairs with a confidence of ``least`` or more; with ``shown`` also the parts and raw texts that reasons are made of."""
    kind = dict(blocks.dtypes)["_id"]
    parts = ("venue", "title", "place", "cities", "within", "same_source")
    schema = f"a {kind}, b {kind}, confidence double, same_day boolean"
    if shown:
        schema += ", venue double, title double, place double, cities boolean, within boolean, same_source boolean, venue_a string, venue_b string, title_a string, title_b string, city_a string"
    cut = _least(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            rows = _Rows(table, law)
            raw = {c: table[f"raw_{c}"].combine_chunks() for c in SHOWN} if shown else {}
            for i, j in rows.pairs():
                got = rows.parts(i, j)
                keep = np.flatnonzero(got["overall"] >= cut)
                for few in np.array_split(keep, max(-(-len(keep) // 20_000), 1)):
                    a, b = i[few], j[few]
                    cols = {"a": rows.ids.take(pa.array(a)), "b": rows.ids.take(pa.array(b)), "confidence": pa.array(_rounded(got["overall"][few])), "same_day": pa.array(got["same_day"][few])}
                    if shown:
                        cols |= {c: pa.array(got[c][few]) for c in parts}
                        cols |= {f"{c}_{n}": raw[c].take(pa.array(k)) for c, n, k in (("venue", "a", a), ("venue", "b", b), ("title", "a", a), ("title", "b", b), ("city", "a", a))}
                    yield pa.RecordBatch.from_pydict(cols)

    return blocks.mapInArrow(run, schema)


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that links (i, j) connect it with."""
    label = np.arange(n)
    while True:
        new, least = label.copy(), np.minimum(label[i], label[j])
        for ends in (i, j, label[i], label[j]):
            np.minimum.at(new, ends, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(rows: _Rows, cut: float) -> np.ndarray:
    """For each row the first that links of its group connect it with."""
    alone, own = (rows.table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_alone", "_own"))
    # rows of one chunk are compared with a row of the other, those of a group that isn't cut with one of their own
    side = rows.group * 2 + (~alone & ~own)
    across = np.where(alone, side, side ^ 1)
    label = np.arange(rows.n)

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        hit = rows.parts(i, j)["overall"] >= cut
        label = _connected(rows.n, np.concatenate([i[hit], label]), np.concatenate([j[hit], np.arange(rows.n)]))

    heads = np.full(2 * len(rows.first), -1)
    for turn in range(TURNS):
        apart = np.flatnonzero(label != label[rows.first][rows.group]) if turn else np.arange(rows.n)
        sides, at = np.unique(side[apart], return_index=True)
        heads[sides] = apart[at]
        some = np.zeros(len(rows.first), bool)
        some[rows.group[apart]] = True
        j = np.flatnonzero(some[rows.group] & (heads[across] >= 0))
        j = j[(rows.id_code[heads[across[j]]] != rows.id_code[j]) & (label[heads[across[j]]] != label[j])]
        if not len(j):
            break
        for few in np.array_split(j, -(-len(j) // PAIRS)):
            join(heads[across[few]], few)
    some = np.zeros(len(rows.first), bool)
    some[rows.group[label != label[rows.first][rows.group]]] = True
    for i, j in rows.pairs(some) if some.any() else ():
        keep = label[i] != label[j]
        if keep.any():
            join(i[keep], j[keep])
    return label


def links(blocks: DataFrame, law: Law, threshold: float) -> DataFrame:
    """a, b: each row of a block and the first that links (confidence of ``threshold`` or more) connect it with there; fewer than the rows.

    The rows are compared with one row of their block, those that this leaves apart with one of these, a few times; then each pair is that isn't connected yet.
    """
    kind, cut = dict(blocks.dtypes)["_id"], _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            rows = _Rows(table, law)
            label = _linked(rows, cut)
            node = np.flatnonzero(label != np.arange(rows.n))
            yield pa.RecordBatch.from_arrays([rows.ids.take(pa.array(label[node])), rows.ids.take(pa.array(node))], ["a", "b"])

    return blocks.mapInArrow(run, f"a {kind}, b {kind}")


def led(members: DataFrame, law: Law, threshold: float) -> DataFrame:
    """node, lead of whole components (rows of ``forms`` with their ``root``): the first id that is in no group leads one and takes all its partners that are in none.

    A partner shares a block with it and has a confidence of ``threshold`` or more. All components of a task take their next lead at once.
    """
    kind, cut = dict(members.dtypes)["_id"], _least(threshold)
    sorted_rows = _by_group(members.withColumn("_keys", F.transform("keys", lambda k: F.xxhash64(k))).drop("keys"), ["root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            rows, keys = _Rows(table, law), _longs(table["_keys"].combine_chunks())
            lead, left = np.arange(rows.n), np.arange(rows.n)
            while len(left):
                groups, at = np.unique(rows.group[left], return_index=True)
                head_of = np.zeros(len(rows.first), np.int64)
                head_of[groups] = left[at]
                i, j = head_of[rows.group[left]], left
                share = np.zeros(len(left), bool)
                for p in range(keys.shape[1]):
                    for q in range(keys.shape[1]):
                        share |= (keys[i, p] == keys[j, q]) & (keys[i, p] != 0)
                taken = i == j
                todo = np.flatnonzero(share & ~taken)
                for few in np.array_split(todo, max(-(-len(todo) // PAIRS), 1)):
                    if len(few):
                        taken[few] = rows.parts(i[few], j[few])["overall"] >= cut
                lead[j[taken]] = i[taken]
                left = left[~taken]
            yield pa.RecordBatch.from_arrays([rows.ids, rows.ids.take(pa.array(lead))], ["node", "lead"])

    return sorted_rows.mapInArrow(run, f"node {kind}, lead {kind}")
