"""Cross-tokenizer alignment: divide and conquer at shared cuts, link counts over the corpus.

A text, with the space that both vocabularies put before it, is coded by a byte-level
vocabulary (A) and by a sentencepiece vocabulary (B). A byte offset where a token of A and
one of B both end is a shared cut. ``shared_cuts`` looks for one near the middle of an
interval: the middle token of A is sought among B's ends by bisect, then its neighbours in
windows of doubling width; the interval is split there and both halves go on. An interval
without a cut inside is a group. All intervals of a batch take a step together, so a
batch needs as many steps as its longest text has halvings.

Tokens of one group are linked, each of A with each of B. ``linked`` gives the number of
documents that hold an id pair linked, whether it is its A id's highest, and from both
the sums of each document. Documents keep their distinct pairs as arrays in a written
table; the most frequent pairs (``FREQUENT`` at most, by share of all) are broadcast, all others are
shuffled, and an A id's highest count is broadcast since ids are bounded by the vocabulary.

Texts are cut into pieces that no token of either vocabulary spans, and each distinct piece
is coded once. A batch holds a bounded number of characters, or one text. A document whose
groups make more than ``AT_ONCE_PAIRS`` pairs is counted in blocks of A ids, each a row of
its own, so memory stays bounded whatever a group's length.

Defined cases: a null or empty text, and one whose tokens don't give its bytes back (a literal
U+2581), have no tokens: zeros and an empty ``groups``; special strings in texts are plain text;
repeated rows, equal and null doc_ids each keep a row; an empty table gives an empty result;
further columns of the documents are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from marquee.llm.tokens import Memo
from marquee.plans.skew import lookup
from marquee.plans.staging import discard, staged

#: Characters of texts that are aligned at once; a longer text goes alone.
AT_ONCE = 2_000_000
#: Pairs of one document that are counted at once; beyond, blocks of A ids.
AT_ONCE_PAIRS = 1 << 23
#: Pairs whose counts are broadcast, at most: 16 bytes each.
FREQUENT = 500_000
#: Distinct pieces kept at most, in both vocabularies and in A's own memo; then each starts anew.
PIECES, WORDS = 500_000, 200_000
_SPACE = "▁"
_LOADED: dict[tuple[str, str], TwoVocabularies] = {}


class _Pool:
    """The ids of known pieces in one vocabulary, one piece's behind another's."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.lengths = tokens, np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.ids = np.zeros(0, np.min_scalar_type(len(tokens) - 1))
        self.first, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, counts: np.ndarray, data: list[bytes], size: np.ndarray) -> np.ndarray:
        """Puts in pieces of ``counts`` ids each; whether the bytes of a piece's tokens are its own, ``data`` of ``size`` bytes."""
        ends, bytes_before = np.cumsum(counts), np.concatenate([[0], np.cumsum(self.lengths[ids])])
        self.first = np.concatenate([self.first, len(self.ids) + ends - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids.astype(self.ids.dtype)]), np.concatenate([self.counts, counts.astype(np.int32)])
        fits = bytes_before[ends] - bytes_before[ends - counts] == size
        got = b"".join(map(self.tokens.__getitem__, ids[np.repeat(fits, counts)].tolist()))
        wanted = b"".join(compress(data, fits.tolist()))
        if got != wanted:
            starts = np.cumsum(size[fits]) - size[fits]
            fits[fits] = np.logical_and.reduceat(np.frombuffer(got, np.uint8) == np.frombuffer(wanted, np.uint8), starts)
        return fits

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces ``at``, and how many each has."""
        each = self.counts[at].astype(np.int64)
        ends = np.cumsum(each)
        place = np.repeat(self.first[at] - ends + each, each) + np.arange(ends[-1])
        return self.ids[place].astype(np.int64), each


class TwoVocabularies:
    """Both libraries, the bytes of their tokens, and the ids of pieces seen."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Memo(path_a), SentencePieceProcessor(model_file=path_b)
        lib = self.a.lib
        shown = {chr(c): b for b, c in _shown_bytes().items()}
        self.bytes_a = [bytes(map(shown.__getitem__, lib.id_to_token(i))) if set(lib.id_to_token(i)) <= shown.keys() else lib.id_to_token(i).encode() for i in range(lib.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        #: pieces may be cut before a space and around a line feed only where no token of B spans that place
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.cuts = self.a.keeps_space and not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in plain) and len(self.b.encode("\n")) == 2
        self.known: dict[str, int] = {}
        self.pool_a, self.pool_b, self.fits = _Pool(self.bytes_a), _Pool(self.bytes_b), np.zeros(0, bool)

    def _cut(self, text: str) -> str:
        """Space and text with NUL between pieces; one piece where cuts aren't certain."""
        if "\0" in text:
            return " "  # stands for the whole text, see ``coded``
        if not self.cuts:
            return f" {text}"
        return f" {self.a._cut(text)}" if not text[0].isspace() else self.a._cut(f" {text}")

    def _ids_a(self, pieces: list[str]) -> list[bytes]:
        if not self.cuts or any("\0" in p for p in pieces):
            return self.a.texts(pieces)
        self.a._learn([p for p in pieces if p not in self.a])  # pieces hold no place for a cut
        return list(map(self.a.__getitem__, pieces))

    def _learn(self, pieces: list[str]) -> None:
        """Puts the pieces' ids behind those of all pieces known, and whether their bytes come back."""
        if len(self.a) > WORDS:
            self.a.clear()
        coded_a = self._ids_a(pieces)
        # a piece that begins with a space gets it from B itself; before any other stands a line feed, left out after
        coded_b = self.b.encode([p[1:] if p[0] == " " else f"\n{p}" for p in pieces], num_threads=1)
        coded_b = [b if p[0] == " " else b[2:] for p, b in zip(pieces, coded_b, strict=True)]
        data, n = list(map(str.encode, pieces)), len(pieces)
        fits, size = np.ones(n, bool), np.fromiter(map(len, data), np.int64, n)
        for side, ids, counts in (
            (self.pool_a, np.frombuffer(b"".join(coded_a), self.a.dtype), np.fromiter(map(len, coded_a), np.int64, n) // self.a.width),
            (self.pool_b, np.fromiter(chain.from_iterable(coded_b), self.pool_b.ids.dtype), np.fromiter(map(len, coded_b), np.int64, n)),
        ):
            fits &= side.add(ids, counts, data, size)
        self.fits = np.concatenate([self.fits, fits])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + n), strict=True))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Each piece's number among those known."""
        if len(self.known) > PIECES:
            self.known.clear()
            self.pool_a, self.pool_b, self.fits = _Pool(self.bytes_a), _Pool(self.bytes_b), np.zeros(0, bool)
        known = self.known
        self._learn([p for p in pieces if p not in known])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts (none empty), the tokens of each text in A and in B, and whether its bytes come back."""
        nul = [k for k, t in enumerate(texts) if "\0" in t]
        cut = [self._cut(t) for t in texts]
        split = pc.split_pattern(pa.array(["\0".join(cut)], pa.large_string()), "\0").flatten().dictionary_encode()
        listed = pa.LargeListArray.from_arrays(pa.array([0, len(split.dictionary)], pa.int64()), split.dictionary)
        pieces, index = pc.binary_join(listed, pa.scalar("\0", pa.large_string()))[0].as_py().split("\0"), split.indices.to_numpy()
        counts = np.fromiter((t.count("\0") + 1 for t in cut), np.int64, len(cut))
        first = np.cumsum(counts) - counts
        if nul:  # such a text is one piece, which can't stand between NULs
            index = index.copy()
            for k in nul:
                index[first[k]] = len(pieces)
                pieces.append(f" {texts[k]}")
        at = self._places(pieces)[index]
        fits = np.logical_and.reduceat(self.fits[at], first)
        out = []
        for pool in (self.pool_a, self.pool_b):
            ids, each = pool.of(at)
            out += [ids, np.add.reduceat(each, first)]
        return out[0], out[2], out[1], out[3], fits


def _shown_bytes() -> dict[int, int]:
    """Byte to the code point that stands for it in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain + rest, plain + list(range(256, 256 + len(rest))), strict=True))


def _digits(n: int) -> np.ndarray:
    """Each id below ``n`` in decimal ASCII, filled with NUL on the left, and one more NUL for a mark."""
    width = len(str(n - 1))
    text = "".join(str(i).rjust(width, "\0") + "\0" for i in range(n))
    return np.frombuffer(text.encode(), np.uint8).reshape(n, width + 1)


def two_vocabularies(path_a: str, path_b: str) -> TwoVocabularies:
    """The worker's pair of vocabularies."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = TwoVocabularies(path_a, path_b)
    return _LOADED[path_a, path_b]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens, in A and in B, with which a group ends.

    ``ends_a`` and ``ends_b`` are rising byte offsets; ``last_a`` are places in A of ends known to be shared, the last of all included.
    """
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    cuts_a, cuts_b = [last_a], [last_b]
    lo, hi = np.concatenate([[0], last_a[:-1] + 1]), last_a  # tokens lo..hi of A; hi ends with a shared cut
    lo_b, hi_b = np.concatenate([[0], last_b[:-1] + 1]), last_b
    while True:
        live = (hi > lo) & (hi_b > lo_b)
        if not live.any():
            break
        lo, hi, lo_b, hi_b = lo[live], hi[live], lo_b[live], hi_b[live]
        at, at_b = _near_middle(ends_a, ends_b, lo, hi)
        cut = at >= 0
        lo, hi, lo_b, hi_b, at, at_b = (x[cut] for x in (lo, hi, lo_b, hi_b, at, at_b))
        cuts_a.append(at)
        cuts_b.append(at_b)
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
        lo_b, hi_b = np.concatenate([lo_b, at_b + 1]), np.concatenate([at_b, hi_b])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _near_middle(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of A's tokens the one nearest to its middle, ``hi`` left out, that ends where one of B ends; -1 if none does."""
    middle = (lo + hi - 1) // 2
    at_b = np.searchsorted(ends_b, ends_a[middle])
    at = np.where(ends_b[at_b] == ends_a[middle], middle, -1)
    todo, near, width = np.flatnonzero(at < 0), 0, 1
    while len(todo):
        m = middle[todo]
        todo = todo[(m - near > lo[todo]) | (m + near + 1 < hi[todo])]  # any token left to try
        if not len(todo):
            break
        steps = np.arange(near + 1, near + width + 1)
        tried = np.stack([middle[todo][:, None] - steps, middle[todo][:, None] + steps], 2).reshape(len(todo), -1)  # nearest first
        inside = (tried >= lo[todo][:, None]) & (tried < hi[todo][:, None])
        ends = ends_a[np.where(inside, tried, 0)]
        found_b = np.searchsorted(ends_b, ends)
        shared = inside & (ends_b[found_b] == ends)
        first, row = shared.argmax(1), np.arange(len(todo))
        hit = shared[row, first]
        at[todo[hit]], at_b[todo[hit]] = tried[row, first][hit], found_b[row, first][hit]
        todo, near, width = todo[~hit], near + width, width * 2
    return at, at_b


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, doc: np.ndarray, size_b: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, pair, its links), each pair of a document once; ``ends_a`` and ``ends_b`` are the groups' ends, ``doc`` their documents."""
    n_a, n_b = np.diff(ends_a, prepend=-1), np.diff(ends_b, prepend=-1)
    space = np.int64(int(ids_a.max()) + 1) * size_b
    weight = n_a * n_b
    of_doc = np.add.reduceat(weight, np.flatnonzero(np.diff(doc, prepend=-1)))
    large = np.isin(doc, np.unique(doc)[of_doc > most])
    if not large.all():
        some = ~large
        a0, b0, k_a, k_b = ends_a[some] - n_a[some] + 1, ends_b[some] - n_b[some] + 1, n_a[some], n_b[some]
        k = np.repeat(k_b, k_a)  # for each token of A
        b = ids_b[np.repeat(np.repeat(b0, k_a), k) + _spread(k)]
        code = np.repeat(np.repeat(doc[some], k_a) * space + ids_a[np.repeat(a0, k_a) + _spread(k_a)] * size_b, k) + b
        code, links = np.unique(code, return_counts=True)
        yield code // space, code % space, links
    for d in np.unique(doc[large]):
        some = np.flatnonzero(doc == d)
        id_a, of_a, m_a = _distinct(ids_a, ends_a[some] - n_a[some] + 1, n_a[some])
        id_b, of_b, m_b = _distinct(ids_b, ends_b[some] - n_b[some] + 1, n_b[some])
        order = np.lexsort((id_b, of_b))  # B's ids by group
        id_b, of_b, m_b = id_b[order], of_b[order], m_b[order]
        b0 = np.searchsorted(of_b, of_a)
        k_b = np.searchsorted(of_b, of_a, "right") - b0
        pairs, edge, at = np.cumsum(k_b), np.flatnonzero(np.diff(id_a, append=-1)) + 1, 0
        for end in edge[np.flatnonzero(np.diff(pairs[edge - 1] // most, append=-1))].tolist():
            k = k_b[at:end]
            b = np.repeat(b0[at:end], k) + _spread(k)
            code, place = np.unique(np.repeat(id_a[at:end] * size_b, k) + id_b[b], return_inverse=True)
            links = np.zeros(len(code), np.int64)
            np.add.at(links, place, np.repeat(m_a[at:end], k) * m_b[b])
            yield np.full(len(code), d), code, links
            at = end


def _distinct(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of groups, each once in a group: id, group and how often, in the order of ids."""
    code = ids[np.repeat(starts, counts) + _spread(counts)] * len(counts) + np.repeat(np.arange(len(counts)), counts)
    code, n = np.unique(code, return_counts=True)
    return code // len(counts), code % len(counts), n


def _written_groups(v: TwoVocabularies, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text; ``last`` are the groups with which texts end."""
    before_b = np.concatenate([[0], ends_b[:-1] + 1])
    n_a, n_b = np.diff(ends_a, prepend=-1), np.diff(ends_b, prepend=-1)
    place_a = np.arange(len(ids_a)) + np.repeat(before_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(ends_a + 1, n_b)
    width = max(v.digits_a.shape[1], v.digits_b.shape[1])
    text = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    text[place_a, width - v.digits_a.shape[1] :] = v.digits_a[ids_a]
    text[place_b, width - v.digits_b.shape[1] :] = v.digits_b[ids_b]
    text[:, -1] = ord(",")
    text[place_a[ends_a], -1] = ord("|")
    text[place_b[ends_b], -1] = ord(";")
    text[place_b[ends_b[last]], -1] = ord("\n")
    return text[text != 0].tobytes().decode("ascii").split("\n")[:-1]


def _schema(path_a: str, path_b: str) -> str:
    small = two_vocabularies(path_a, path_b)
    pair = "int" if len(small.len_a) * len(small.len_b) < 1 << 31 else "long"
    return f"row long, part int, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{pair}>, links array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, at_once_pairs: int = AT_ONCE_PAIRS) -> DataFrame:
    """A row (``part`` 0) for each document: ``row`` (a number), doc_id, n_a, n_b, n_groups, n_links, groups, and its distinct pairs
    (A id times B's size plus B id) with their links. Pairs of very long groups follow in rows of further parts. Not yet written: the caller keeps what it needs.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"{_schema(path_a, path_b)}, doc_id {numbered.schema['doc_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = two_vocabularies(path_a, path_b)
        for b in _sized(batches):
            yield from _aligned_batch(v, b.column(0), b.column(1), b.column(2).to_pylist(), at_once_pairs)

    return numbered.mapInArrow(run, schema)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``AT_ONCE`` bytes of text at most where they have more than one row."""
    for b in batches:
        size, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + AT_ONCE, "right")))
            yield b.slice(at, end - at)
            at = end


def _aligned_batch(v: TwoVocabularies, rows: pa.Array, ids: pa.Array, texts: list[str | None], most: int) -> Iterator[pa.RecordBatch]:
    n = len(texts)
    size_b = len(v.len_b)
    counts = np.zeros((4, n), np.int64)
    groups: list[str] = [""] * n
    part_doc, part_pair, part_links = (np.zeros(0, np.int64),) * 3
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    full = np.array([k for k, t in enumerate(texts) if t], np.int64)
    if len(full):
        ids_a, ids_b, n_a, n_b, fits = v.coded([texts[k] for k in full])
        keep_a, keep_b = np.repeat(fits, n_a), np.repeat(fits, n_b)
        ids_a, ids_b, n_a, n_b, full = ids_a[keep_a], ids_b[keep_b], n_a[fits], n_b[fits], full[fits]
    if len(full):
        ends_a, ends_b = shared_cuts(np.cumsum(v.len_a[ids_a]), np.cumsum(v.len_b[ids_b]), np.cumsum(n_a) - 1)
        last = np.searchsorted(ends_a, np.cumsum(n_a) - 1)  # the group with which each text ends
        n_groups = np.diff(last, prepend=-1)
        doc = np.repeat(full, n_groups)
        weight = np.diff(ends_a, prepend=-1) * np.diff(ends_b, prepend=-1)
        n_links = np.add.reduceat(weight, last - n_groups + 1)
        counts[:, full] = n_a, n_b, n_groups, n_links
        for k, text in zip(full.tolist(), _written_groups(v, ids_a, ids_b, ends_a, ends_b, last), strict=True):
            groups[k] = text
        more = list(_pairs(ids_a, ids_b, ends_a, ends_b, doc, size_b, most)) if n_links.max() <= most else []
        if len(more) == 1:
            part_doc, part_pair, part_links = more.pop()
    kind = pa.int32() if len(v.len_a) * size_b < 1 << 31 else pa.int64()

    def batch(at: np.ndarray, part: int, d: np.ndarray, pair: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([np.searchsorted(d, at), [len(d)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(pair, kind)), pa.ListArray.from_arrays(offsets, pa.array(links, pa.int64()))]
        own = [pa.array(c[at]) for c in counts] + [pa.array([groups[k] for k in at.tolist()] if not part else [""] * len(at), pa.string())]
        names = ["row", "part", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links", "doc_id"]
        return pa.RecordBatch.from_arrays([rows.take(pa.array(at)), pa.array(np.full(len(at), part, np.int32)), *own, *lists, ids.take(pa.array(at))], names)

    yield batch(np.arange(n), 0, part_doc, part_pair, part_links)
    if len(full) and n_links.max() > most:
        for part, (d, pair, links) in enumerate(_pairs(ids_a, ids_b, ends_a, ends_b, doc, size_b, most), 1):
            yield batch(np.unique(d), part, d, pair, links)


def linked(rows: DataFrame, size_b: int) -> DataFrame:
    """``row``, n_best and count_sum of the documents in ``rows`` (as ``aligned`` gives them, written) that have links."""
    counts = staged(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.expr(f"pair div {size_b}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A
    known = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    known = staged(known.select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best"), "n"), "pairs")
    held = rows.select("row", F.inline(F.arrays_zip("pairs", "links"))).withColumnRenamed("pairs", "pair")
    found = lookup(held, known, ["pair"], "n", keys=FREQUENT)
    best: Column = F.sum(F.when(F.col("best"), F.col("links")).otherwise(0))
    out = staged(found.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")), "linked")
    discard(counts, known)
    return out


def alignment_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = staged(aligned(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    sums = linked(rows, len(two_vocabularies(path_a, path_b).len_b))
    of = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.where("part = 0").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", of("n_best"), of("count_sum"), "groups_sha256")
