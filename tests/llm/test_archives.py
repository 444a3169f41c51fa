"""Archives of other writers, hot payloads, layouts with further fields, rejects, wide vocabularies."""

import base64
import hashlib
import io
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from marquee.llm import chat, packing, tokens, warc
from marquee.llm.tokens import Memo, memo


def member(head, block):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join([head[0], *(f"{k}: {v}" for k, v in head[1:]), f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def archive():
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    http = ("Content-Type", "application/http; msgtype=response")
    return b"".join([
        member(["WARC/1.0", ("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Filename", "x.warc.gz"), ("Content-Type", "application/warc-fields")], b"software: other\r\n"),
        member(["WARC/1.0", ("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member(["WARC/1.0", ("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "<http://a/>"), ("WARC-Payload-Digest", f"sha1:{sha1}"), http], page),
        member(["WARC/1.1", ("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"hello").hexdigest()), http], page),
        member(["WARC/1.1", ("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:5>"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", "blake3:xyz"), http], chunked),
        member(["WARC/1.1", ("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:6>"), ("WARC-Refers-To", "<urn:uuid:3>"), http], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        member(["WARC/1.1", ("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:uuid:7>"), ("Content-Type", "application/warc-fields")], b""),
    ])


def test_archives_of_other_writers(spark, tmp_path):
    got = list(warc.read_records(io.BytesIO(archive())))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "metadata"]
    assert [r["payload"] for r in got] == [b"software: other\r\n", b"", b"hello", b"hello", b"5\r\nhello\r\n0\r\n\r\n", None, b""]
    assert got[2]["url"] == "http://a/" and got[2]["page_id"] is None and got[5]["payload_bytes"] is None
    path = tmp_path / "x.warc.gz"
    path.write_bytes(archive())
    files = spark.createDataFrame([(f"file://{path}",)], "path string")
    assert [r["record_id"] for r in warc.read_warc(files).collect()] == [f"urn:uuid:{k}" for k in (3, 4, 5, 6)]
    assert warc.read_warc(files, types=()).count() == 7
    bad = member(["WARC/1.0", ("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Block-Digest", "sha1:AAAA")], b"hello")
    for data in (bad, member(["WARC/1.0", ("WARC-Record-ID", "<x>")], b""), member(["HTTP/1.0", ("WARC-Type", "x")], b"")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data)))


def test_hot_payload_and_no_pages(spark):
    rows = [(k, "u", "same" if k % 2 else f"page {k}") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(pages)).collect()}
    assert got == {k: ("revisit", 1) if k % 2 and k > 1 else ("response", None) for k in range(3000)}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_further_fields_and_rejects(spark):
    rows = [
        (1, '{"messages": [{"role": "human", "content": "q", "name": "x"}, {"role": "gpt", "content": "a", "id": 7}], "conv_id": 1, "model": "m"}'),
        (2, '{"conv_id": 2, "turn": 0, "role": "human", "text": "kept as it is", "lang": "en"}'),
        (3, '{"messages": [], "x": 1}'),
        (4, '{"broken": '),
        (5, None),
        (6, "[1]"),
        (7, '{"conv_id": 7, "turn": null, "role": null, "text": null}'),
    ]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, json string"))
    assert sorted((r["conv_id"], r["why"]) for r in chat.rejects(turns).collect()) == [(3, "unknown"), (4, "unreadable"), (5, "unreadable"), (6, "unknown")]
    shown = {}
    for r in chat.formatted(chat.known(turns)).orderBy("conv_id", "seq").collect():
        shown.setdefault(r["conv_id"], []).extend(chat.parse_turns(r["formatted"]))
    assert shown == {1: [("user", "q"), ("assistant", "a")], 2: [("human", "kept as it is")], 7: [("", "")]}
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.formatted(chat.known(turns))).collect()}
    assert got == {1: 2, 2: 1, 7: 1}
    assert chat.digests(chat.formatted(chat.known(turns.limit(0)))).count() == 0


def test_wide_vocabulary():
    m = Memo(public_tokenizers.path("byte_bpe_50k.json"))
    m.width, m.code, m.dtype = 4, "I", "<u4"
    for text in ("a word, then 12 more.", "", "x  y\n\nz é"):
        assert np.frombuffer(m.texts([text])[0], "<u4").tolist() == m.lib.encode(text, add_special_tokens=False).ids


def test_memo_keeps_common_pieces_and_bounds_memory(monkeypatch):
    """A piece met again and again is learned once, however often the memo fills; joining takes parts of the texts."""
    learned, learn = [], Memo._learn
    monkeypatch.setattr(Memo, "_learn", lambda self, new: learned.extend(new) or learn(self, new))
    monkeypatch.setattr(tokens, "MEMO", 300)
    m, most = Memo(public_tokenizers.path("word_bpe_49k.json")), 0
    for k in range(30):
        text = " ".join(["common words, stay", *(f"n{k}x{j}" for j in range(100))])
        assert np.frombuffer(m.texts([text])[0], "<u2").tolist() == m.lib.encode(text, add_special_tokens=False).ids
        most = max(most, len(m) + len(m.older))
    assert learned.count("common") == learned.count("words,") == 1
    assert most <= 2 * 410
    texts = ["common words, stay " * 100] * 2000
    m.texts(texts[:1])
    tracemalloc.start()
    out = m.texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out) == set(m.texts(texts[:1]))
    assert peak < 20_000_000


def test_packed_pieces_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    long = " ".join(f"w{k % 97} x{k}" for k in range(3000))
    texts = [(1, None), (2, ""), (3, long), (4, "short text"), (4, "short text"), (None, "no id"), (5, "one two three " * 40)]
    _, places = packing.packed_documents(spark.createDataFrame(texts, "doc_id long, text string"), path, tokens=512)
    want = []
    for d, t in texts:
        ids = np.array([*memo(path).lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, min(512, len(ids) - s), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    got = places.collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in got}) == -(-sum(w[3] for w in want) // 512)


def test_records_that_can_not_be_turns(spark):
    """Numbers that aren't integers, half surrogate pairs and deep nesting are rejects, not the job's end."""
    row = '{{"conv_id": 1, "turn": {0}, "role": "user", "text": "{1}"}}'
    records = [(1, row.format('"x"', "a")), (2, row.format("1", "\\ud800")), (3, "[" * 100_000 + "]" * 100_000), (4, row.format("1.5", "a")), (5, row.format("1e30", "a")), (6, row.format("true", "a")), (7, row.format("2.0", "fine")), (8, row.format("null", "too")), (9, '{"a": ' * 3000 + "1" + "}" * 3000)]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, json string"))
    assert sorted((r["conv_id"], r["why"]) for r in chat.rejects(turns).collect()) == [(1, "turn"), (2, "unreadable"), (3, "unreadable"), (4, "turn"), (5, "turn"), (6, "turn"), (9, "unreadable")]
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in chat.known(turns).collect()) == [(7, 2, "fine"), (8, None, "too")]
