"""WARC archives: a writer with payload deduplication and a sequential reader.

Written: one gzip member a record. Of records whose payloads are equal (SHA-1) and have
``min_bytes`` at least, that with the smallest page_id is a ``response``; the others are
``revisit`` records, which hold the HTTP header but no payload and name the response.

Read: a file is decompressed member by member as it streams in; records of every type are
framed by Content-Length, and block and payload digests are verified where a record states
them in a known form (SHA-1, SHA-256 or MD5, in base32 or hex). Archives of other writers are read
too: ids that aren't ours leave page_id null, and ``types`` names the record types wanted. A
cut-off, wrongly framed or altered file raises ``ValueError``.

Equal payloads meet as (digest, smallest id) sums, combined before the shuffle. Only pages whose
digest may be shared are joined with these, and a digest that many pages share is broadcast, so
neither unique pages nor those of a hot digest move. Each task writes files of its own
rows. Memory is one record, at either end.

Defined cases: a null html is an empty payload; a null url is written as an empty one; a
null page_id is never the smallest, and where all are null every record is a response;
rows that repeat the smallest page_id with the same payload are all responses; an empty
table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.files import opened, written
from marquee.plans.skew import lookup, may_be_in
from marquee.plans.staging import discard, new_path, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
_URN = "urn:page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": "".join(url.split("\r")).replace("\n", ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{_URN}{refers_to}>", "WARC-Profile": PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(text.encode() + block + b"\r\n\r\n") + deflate.flush()


def _members(file: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member in turn."""
    held = [file.read(CHUNK)]

    def one() -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        data = held[0]
        while not inflate.eof:
            if not data and not (data := file.read(CHUNK)):
                raise ValueError("the file ends within a record")
            try:
                out = inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            data = inflate.unconsumed_tail
            if out:
                yield out
        held[0] = inflate.unused_data or file.read(CHUNK)

    while held[0]:
        chunks = one()
        yield chunks
        for _ in chunks:  # what the caller left
            pass


def _agrees(stated: str, hashes: dict) -> bool:
    """Whether a digest as records state it, ``algorithm:value``, is that of the hashed bytes; unknown forms count as agreeing."""
    name, _, value = stated.partition(":")
    h = hashes.get(name.lower().replace("-", ""))
    return h is None or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=") or value.lower() == h.hexdigest()


def _hashes(*stated: str | None) -> dict:
    """The hashes that these digests need."""
    names = {s.partition(":")[0].lower().replace("-", "") for s in stated if s}
    return {n: hashlib.new(n) for n in names & {"sha1", "sha256", "md5"}}


def read_records(file: BinaryIO, with_payload: bool = True) -> Iterator[dict]:
    """record_type, record_id, page_id, url, refers_to, payload_bytes, payload_digest and payload of each record.

    A payload is what follows the HTTP header, or the whole block of a record without one. ``payload_bytes``
    of a revisit is the length that its HTTP header states, null where it has none.
    """
    for chunks in _members(file):
        data = b""
        while (at := data.find(b"\r\n\r\n")) < 0:
            data += next(chunks, b"") or _bad("no end of a record's header")
        version, *lines = data[:at].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not version.startswith("WARC/") or not head.get("content-length", "").isdigit() or "warc-type" not in head:
            _bad("not a record's header")
        left, data, kind = int(head["content-length"]), data[at + 4 :], head["warc-type"]
        of_block, of_payload = head.get("warc-block-digest"), head.get("warc-payload-digest")
        block, body, http, payload, size = _hashes(of_block), _hashes(of_payload), b"", [], 0
        in_http = kind in ("response", "revisit", "request") and head.get("content-type", "").startswith("application/http")
        while left:
            data = data or next(chunks, b"") or _bad("a record's block is too short")
            part, data = data[:left], data[left:]
            left -= len(part)
            for h in block.values():
                h.update(part)
            if in_http and b"\r\n\r\n" not in http:
                http, end, part = (http + part).partition(b"\r\n\r\n")
                http += end
            for h in body.values():
                h.update(part)
            size += len(part)
            if with_payload:
                payload.append(part)
        if (data + b"".join(chunks)) != b"\r\n\r\n":
            _bad("a record's end is not where its length says")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n"))}
        stated, coded = fields.get(b"content-length", b""), b"transfer-encoding" in fields
        whole = kind not in ("revisit", "request") and not coded
        if of_block and not _agrees(of_block, block) or of_payload and whole and not _agrees(of_payload, body) or whole and stated.isdigit() and int(stated) != size:
            _bad("a digest or length doesn't match")
        yield {
            "record_type": kind,
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "page_id": _page(head.get("warc-record-id", "")),
            "url": head.get("warc-target-uri", "").strip("<>"),
            "refers_to": _page(head.get("warc-refers-to", "")),
            "payload_bytes": size if kind != "revisit" else int(stated) if stated.isdigit() else None,
            "payload_digest": of_payload.removeprefix("sha1:") if of_payload else None,
            "payload": b"".join(payload) if with_payload and kind != "revisit" else None,
        }


def _page(record_id: str) -> int | None:
    """The page_id in an id that this module wrote."""
    number = record_id.strip("<>").removeprefix(_URN)
    return int(number) if record_id.strip("<>").startswith(_URN) and number.lstrip("-").isdigit() else None


def _bad(what: str) -> bytes:
    raise ValueError(what)


def write_warc(pages: DataFrame, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html); a row (path, n_records) for each file."""
    path = new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= min_bytes
    shared = rows.where(large).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    shared = staged(shared, "shared")
    marked, on, working = may_be_in(rows, F.col("_digest"), shared.select("_digest"))
    marked = marked.withColumn("_maybe", on & large).drop(*working)
    several = lookup(marked.where("_maybe"), shared, ["_digest"], "_n", "left")
    columns = ("page_id", "url", "html", "_first")
    rows = marked.where("not _maybe").withColumn("_first", F.lit(None).cast("long")).select(*columns).union(several.select(*columns))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))
    rows = rows.select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], date) for b in batches for r in b.to_pylist())
        for k in itertools.count():
            first = next(records, None)
            if first is None:
                return
            file, n, size = f"{path}/{TaskContext.get().partitionId():06d}-{k:04d}.warc.gz", 0, 0
            with written(file) as out:
                for data in itertools.chain([first], records):
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= file_bytes:
                        break
            yield pa.RecordBatch.from_pydict({"path": [file], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    files = staged(rows.mapInArrow(write, "path string, n_records long"), "warc-files")
    discard(shared)
    return files


def read_warc(files: DataFrame, with_payload: bool = True, types: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """The records of ``types`` (all, if empty) in the files named in ``files`` (path); see ``read_records``."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    records = (r for r in read_records(file, with_payload) if not types or r["record_type"] in types)
                    while part := list(itertools.islice(records, 64)):
                        yield pa.RecordBatch.from_pylist(part, schema)

    spread = files.select("path").repartition(max(1, min(files.count(), 4096)))
    return spread.mapInArrow(read, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
