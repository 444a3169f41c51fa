"""Cross-tokenizer alignment against a plain version that intersects the ends of both libraries' tokens."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marquee.llm import alignment
from marquee.llm.queries import QUERIES
from marquee.llm.tokens import Memo

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (None, None), (1, ""), (2, " "), (3, "  a  b"), (4, "\n\nx\n"), (5, "a▁b"), (6, "x\0y z"), (7, "<|endoftext|> </s> <s>"), (8, "日本語のテキスト。漢字かな交じり文" * 30),
    (9, "aaaaaaaaaaaaaaaaaaaaaaa" * 50), (9, "a\tb\r\nc   d"), (None, "🤦🏽‍♂️ emoji 🤷 x"), (11, "ﷺ ﷽ ὗ " * 20), (12, "İstanbul naïve Ünïcode"), (13, "(((((){}{}{};;;;\n\t\t\t\tfoo();\n"), (14, "\n"), (15, "\0"), (16, " \x85x"), (17, "x" * 70_000), (12, "İstanbul naïve Ünïcode"),
]


def plain(rows):
    """The contract's columns, with sets of ends and all links enumerated."""
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {chr(c): b for b, c in alignment._shown_bytes().items()}
    held, docs = collections.Counter(), []
    for doc_id, text in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            ids = lib.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            data = [bytes(shown[c] for c in lib.id_to_token(k)) for k in ids[0]], [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]]
            if b"".join(data[0]) == b"".join(data[1]) == (" " + text).encode():
                n_a, n_b = map(len, ids)
                ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
                cuts, parts = set(ends[0]) & set(ends[1]), []
                for side in (0, 1):
                    part = [[]]
                    for k, e in zip(ids[side], ends[side], strict=True):
                        part[-1].append(k)
                        if e in cuts:
                            part.append([])
                    parts.append(part[:-1])
                groups = list(zip(*parts, strict=True))
        links = collections.Counter((a, b) for x, y in groups for a in x for b in y)
        held.update(links.keys())
        docs.append((doc_id, n_a, n_b, groups, links))
    best = collections.Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for doc_id, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "")


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("most", [alignment.AT_ONCE_PAIRS, 40])
def test_odd_texts(spark, monkeypatch, most):
    """Nulls, special strings, lossy texts, long groups, repeated rows; with 40 pairs at once most documents are counted in blocks."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, pairs string")
    whole = alignment.aligned
    monkeypatch.setattr(alignment, "aligned", lambda d, a, b: whole(d, a, b, most))
    assert _sorted(alignment.alignment_counts(docs, A, B).collect()) == _sorted(plain(ODD))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert _sorted(QUERIES["op11_tokenizer_alignment"](spark, sf).collect()) == _sorted(plain(docs))


def test_empty_table_and_rare_pairs(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.alignment_counts(empty, A, B).collect() == []
    monkeypatch.setattr(alignment, "FREQUENT", 20)  # most pairs go by the shuffle
    rows = [("a", "the cat sat on the mat. " * 20), ("b", "the dog sat"), ("c", "the naïve cat")]
    assert _sorted(alignment.alignment_counts(spark.createDataFrame(rows, "doc_id string, text string"), A, B).collect()) == _sorted(plain(rows))


def test_shared_cuts():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 200, 5000):
        total = 10 * n
        ends_a, ends_b = (np.unique(np.append(r.integers(1, total, n), total)) for _ in range(2))
        a, b = alignment.shared_cuts(ends_a, ends_b, np.array([len(ends_a) - 1]))
        want = np.intersect1d(ends_a, ends_b)
        assert (ends_a[a] == want).all() and (ends_b[b] == want).all()


def test_pieces_are_cut_once_and_memo_starts_anew(monkeypatch):
    """A piece is learned as it was cut from its text; ids and the check of bytes stay right when few pieces are kept."""
    seen, cut = [], Memo._cut
    monkeypatch.setattr(Memo, "_cut", lambda self, text: seen.append(text) or cut(self, text))
    texts = [t for _, t in ODD if t and "\0" not in t]
    v = alignment.TwoVocabularies(A, B)
    whole = v.coded(texts)
    assert len(seen) == len(texts)
    assert [t for t, fits in zip(texts, whole[4], strict=True) if not fits] == ["a▁b"]
    monkeypatch.setattr(alignment, "PIECES", 3)
    monkeypatch.setattr(alignment, "WORDS", 2)
    for _ in range(2):
        each = [v.coded([t]) for t in texts]
        assert all((np.concatenate([x[k] for x in each]) == whole[k]).all() for k in range(5))
