"""Best-fit packing of documents into sequences, over several capacities at once.

Pieces go in falling length to the open sequence that fits under every capacity
(tokens, documents, attention cost) and has, afterwards, the smallest weighted norm of
what is left (``rule="norm"``), or the largest weighted dot product of demand and what
is left (``rule="dot"``). Where none fits, a sequence is opened.

Pieces are dealt to groups of about ``group_pieces`` by a hash of their number, and each
group is packed alone in one task: a group holds thousands of sequences, so what its
last few leave free is lost among them, and memory doesn't grow with the input.

Defined cases: a null text is empty (its piece is the end id alone); null and repeated
doc_ids are packed like any other, a row at a time; a text of any length is cut into
pieces of the capacity and only its last piece may be shorter; ties go to the sequence
opened first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.tokens import give_back, memo
from marquee.plans.staging import staged

#: Documents of a batch that become Python objects at once.
AT_ONCE = 1024


def pieces(docs: DataFrame, tokenizer: str, *, tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids for the pieces of every document.

    ``ids`` holds little-endian unsigned 32-bit integers; a document ends with ``end_id``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = memo(tokenizer)
        end = np.array([end_id], m.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(at, AT_ONCE), []
                for doc_id, data in zip(part.column(0).to_pylist(), m.texts(part.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(data + end, m.dtype).astype("<u4")
                    rows += [(doc_id, k, s, min(tokens, len(ids) - s), ids[s : s + tokens].tobytes()) for k, s in enumerate(range(0, len(ids), tokens))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each length; see the module's text."""
    cap, weight = np.array(capacity, float), np.array(weights, float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = np.minimum.accumulate(lengths[order][::-1])[::-1] if len(lengths) else lengths
    left, number, n_open, used = np.zeros((8192, 3)), np.zeros(8192, np.int64), 0, 0
    for step, i in enumerate(order):
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        rest = left[:n_open] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            if rule == "norm":
                value = ((rest[fits] / cap) ** 2 * weight).sum(axis=1)
                b = fits[int(np.argmin(value))]
            else:
                value = (left[fits] / cap * (need / cap) * weight).sum(axis=1)
                b = fits[int(np.argmax(value))]
        else:
            if (need > cap).any():
                raise ValueError("a piece exceeds a capacity by itself")
            if n_open == len(left):
                left, number = np.concatenate([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)])
            b, left[n_open], number[n_open], n_open, used = n_open, cap, used, n_open + 1, used + 1
        bins[i], offsets[i] = number[b], int(cap[0] - left[b, 0])
        left[b] -= need
        if step % 256 == 255 and step + 1 < len(order):  # full sequences need not be looked at again
            live = np.flatnonzero((left[:n_open, 0] >= smallest[step + 1]) & (left[:n_open, 1] >= 1))
            left[: len(live)], number[: len(live)], n_open = left[live], number[live], len(live)
    return bins, offsets


def pack(rows: DataFrame, *, tokens: int = 4096, documents: int = 4096, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", group_pieces: int = 40_000) -> DataFrame:
    """``rows`` (with ``length``, none above ``tokens``) with sequence_id and offset.

    ``documents`` and ``attention`` (sum of squared lengths; ``tokens`` squared if None,
    which never binds) limit a sequence further. ``rows`` should be a written table.
    """
    capacity = (tokens, documents, attention or float(tokens) ** 2)
    groups = max(1, -(-rows.select("length").count() // group_pieces))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns=["_group"])
        bins, offsets = best_fit(part["length"].to_numpy(), capacity, weights, rule)
        return part.assign(sequence_id=int(key[0]) * 10**9 + bins, offset=offsets)

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)).cast("int")) if "_uid" in rows.columns else rows.withColumn("_group", F.pmod(F.xxhash64(*rows.columns), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(one, f"{columns}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, **options) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and (by ``_uid``) where each lies.

    The first is written once, so that packing and reading ids don't encode again.
    """
    tokens = options.get("tokens", 4096)
    cut = staged(pieces(docs, tokenizer, tokens=tokens, end_id=options.pop("end_id", 1)).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    places = pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), **options)
    return cut, places
