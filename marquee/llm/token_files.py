"""Token-id files: fixed-width bit packing with block offsets.

Layout of a file (all integers little-endian):

    b"MQPK"  bits u8  3 zero bytes  block u32      header of 12 bytes
    payload  blocks of ``block`` ids, each id in ``bits`` bits, a block ends on a byte
    offsets  u64 for each block, from the file's start, and one for the payload's end
    docs     i64 doc_id, u8 null flag and u64 first id, three arrays over the documents
    tail     n_ids u64, n_docs u64, b"MQPK"        20 bytes

``bits`` is the least width that holds the vocabulary. A block's ids unpack in one numpy
step, and the offsets give random access to any id or document.

Documents are range-partitioned and sorted by doc_id and a hash of the text; each partition streams into one
file. Memory is a block plus 17 bytes a document of the file. Starts over all files come
from a running sum of one row a file.

Defined cases: a null text is empty (it still gets its end id); a null doc_id comes last;
equal doc_ids are ordered by a hash of the text; an empty table gives no files and an empty result;
other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.tokens import give_back, memo
from marquee.plans.files import opened, written
from marquee.plans.staging import new_path, staged

MAGIC = b"MQPK"
BLOCK = 8192
#: Documents of a batch that become Python objects at once.
AT_ONCE = 1024


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    split = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(split.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    split = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (split.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


class Writer:
    """Writes one file; ids come document by document."""

    def __init__(self, out, bits: int, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.ids, self.starts = [12], [], []
        out.write(MAGIC + bytes([bits, 0, 0, 0]) + np.array(block, "<u4").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        joined = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for at in range(0, n, self.block):
            data = pack(joined[at : min(at + self.block, n)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [joined[n:]], len(joined) - n

    def close(self) -> None:
        self._flush(self.n_held)
        arrays = (np.array(self.offsets, "<u8"), np.array([x or 0 for x in self.ids], "<i8"), np.array([x is None for x in self.ids], np.uint8), np.array(self.starts, "<u8"))
        self.out.write(b"".join(a.tobytes() for a in arrays) + np.array([self.n_ids, len(self.ids)], "<u8").tobytes() + MAGIC)


class Reader:
    """Random access to one file of ids."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        head, tail = self._bytes(0, 12), self._bytes(size - 20, 20)
        if head[:4] != MAGIC or tail[16:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.bits, self.block = head[4], int.from_bytes(head[8:12], "little")
        self.n_ids, n_docs = (int(x) for x in np.frombuffer(tail, "<u8", 2))
        n_blocks = -(-self.n_ids // self.block)
        at = size - 20 - 17 * n_docs - 8 * (n_blocks + 1)
        rest = self._bytes(at, size - 20 - at)
        self.offsets = np.frombuffer(rest, "<u8", n_blocks + 1)
        rest = rest[8 * (n_blocks + 1) :]
        self.nulls = np.frombuffer(rest, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = np.frombuffer(rest, "<i8", n_docs)
        self.starts = np.append(np.frombuffer(rest, "<u8", n_docs, 9 * n_docs), np.uint64(self.n_ids)).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` up to ``end``, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        data, base = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first])), int(self.offsets[first])
        if self.bits in (8, 16, 32):  # no padding between blocks
            whole = unpack(data, self.bits, min((last + 1) * self.block, self.n_ids) - first * self.block)
        else:
            counts = [min(self.block, self.n_ids - k * self.block) for k in range(first, last + 1)]
            whole = np.concatenate([unpack(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, n) for k, n in zip(range(first, last + 1), counts, strict=True)])
        return whole[start - first * self.block : end - first * self.block]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in this file, number of ids and their crc32, reading ``at_once`` ids at a time."""
        low, held = 0, np.zeros(0, "<u4")
        for k in range(len(self.doc_ids)):
            start, end, crc, at = int(self.starts[k]), int(self.starts[k + 1]), 0, int(self.starts[k])
            while at < end:
                if at >= low + len(held):
                    low, held = at, self.ids(at, min(at + at_once, self.n_ids))
                part = held[at - low : end - low]
                crc, at = zlib.crc32(part.tobytes(), crc), at + len(part)
            yield None if self.nulls[k] else int(self.doc_ids[k]), start, end - start, crc


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 2, docs_per_file: int = 8_000, vocabulary: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ascending doc_id order.

    Returns a row for each file: number (in that order), path, n_docs, n_ids.
    """
    path = new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        file = f"{path}/{number:06d}.mqpk"
        m = memo(tokenizer)
        bits = max(((vocabulary or m.lib.get_vocab_size()) - 1).bit_length(), end_id.bit_length(), 1)
        end = np.array([end_id], m.dtype).tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written(file) as out:
            writer = Writer(out, bits)
            for batch in itertools.chain([first], batches):
                _add(writer, m, batch, end)
            writer.close()
        yield pa.RecordBatch.from_pylist([{"number": number, "path": file, "n_docs": len(writer.ids), "n_ids": writer.n_ids}], pa.schema([("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    n_files = max(1, -(-docs.select("doc_id").count() // docs_per_file))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))  # rows of one doc_id may span files
    ordered = ordered.repartitionByRange(n_files, *order).sortWithinPartitions(*order, "text")
    return staged(ordered.mapInArrow(write, "number int, path string, n_docs long, n_ids long"), "token-files")


def _add(writer: Writer, m, batch: pa.RecordBatch, end: bytes) -> None:
    for at in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(at, AT_ONCE)
        for doc_id, data in zip(part.column(0).to_pylist(), m.texts(part.column(1).to_pylist()), strict=True):
            writer.add(doc_id, np.frombuffer(data + end, m.dtype).astype("<u4"))
    give_back()


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it over all files), n_tokens, ids_crc32, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    rows = [(d, row["before"] + s, n, c) for d, s, n, c in Reader(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    listed = files.select("path", before)
    spread = listed.repartition(max(1, min(files.count(), 4096)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
