"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Documents link when the Jaccard similarity of their sets of 5-word shingles reaches a
threshold (75 %). No link is lost; what is left out can't reach the threshold:

1. A document's set is a sorted array of 64-bit shingle hashes. Equal sets form a class
   (128-bit key); a task passes on one document of each class it sees.
2. All shingles have one order, common ones last. Two sets that link share a shingle
   among the first n - ceil(3n/4) + 1 of each (prefix filter).
3. A tile holds the documents that share such a shingle, sorted by size, so that only a
   window of sizes is compared; places in the order bound the overlap further.
4. Each document has a bitmap of its hashed shingles. Bits set in one and not in the
   other count shingles that can't be shared, which bounds the overlap from above.
5. Pairs that pass are decided by intersecting the sorted arrays, made anew from the texts.

Groups of near copies would still give all their pairs. So documents with equal
min-hashes are first compared to one of them, then each document to a few others of
each of its tiles; links found so are joined to components, and the tiles' last pass
takes all pairs but those that are in one component already: those are connected and
need no comparing. Only components are asked for, so this loses nothing.

The tiles are made once: all prefixes are shuffled as narrow rows, and only rows whose
tile holds another row of a fitting size are written for the passes. Tiles of more than
``hot_docs`` rows are cut by size bands and blocks and compared by their bitmaps at once
(``_hot_pairs``): those of shingles that the list below shows to be so common never pass one task, and what
the list undercounts is found by exact counts while the tiles are made (a task then sorts that tile's narrow rows,
spilling). Other tiles' pairs are made and filtered ``PAIRS`` at a time. Of the texts only those
in a candidate pair are shuffled. Keys that hold much of a table (a class of exact copies,
a large component, a min-hash) are looked up by broadcast, of a bounded number of rows.
Written tables are deleted as soon as what reads them is written.

"Common" is a list of at most ``LATE`` shingles by document counts, a bound of 8 bytes
each; any list gives the same result. Hash collisions (2^-64 a pair of shingles) aside,
results are exact.

Defined cases: texts that are null, or without words, have an empty set, link with
nothing and are components of their own; repeated rows are one class; a null doc_id
counts for no component's name, but its row gets that name; a text of any length is read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.components import connected_components, extended_components
from marquee.plans.rows import packed, unpacked
from marquee.plans.skew import lookup, may_be_in
from marquee.plans.staging import discard, staged

N = 5
PERCENT = 75
#: Most shingles in the list of common ones, and the least documents that make one common.
LATE, LATE_DOCS = 500_000, 8
#: Documents that make a shingle's tile a hot one: a colder one has at most some millions of pairs.
HOT_DOCS = 2_000
#: Pairs of rows that are held at once in a tile's comparison.
PAIRS = 1 << 20
MIN_HASHES = 6
#: Rows that a row meets in each of its tiles in the first pass over them.
FEW = 6
_K = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles, ASCII letters lower-cased."""
    words = text.encode().lower().split() if text else []  # bytes: both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(N, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * _K
        h ^= h >> np.uint64(29)
    if n < N:
        h ^= np.uint64(n)
    return np.unique(h * _MIXERS[0])


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of ``n`` with any set it links with."""
    return (PERCENT * n + 99) // 100


def needed_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of ``n`` and ``m``: o / (n + m - o) >= PERCENT / 100."""
    return -(-(PERCENT * (n + m)) // (100 + PERCENT))


def bitmap(tokens: np.ndarray) -> bytes:
    """Hashed bitmap, of a power of two of bits, about two for each token."""
    width = min(8192, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(17)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def overlap_bound(n: int, m: int, a: bytes, b: bytes) -> int:
    """At most so many tokens can be shared, going by the bitmaps; the wider is folded."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    width = min(len(x), len(y))
    x, y = (v.reshape(-1, width).max(axis=0) for v in (x, y))
    return min(n - int((x > y).sum()), m - int((y > x).sum()))


def _counted(docs: DataFrame, chunk: int = 1_500_000) -> DataFrame:
    """token, n: documents that hold it, summed over those chunks where at least two do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"token": tokens[n > 1].view(np.int64), "n": n[n > 1]}, pa.schema([("token", pa.int64()), ("n", pa.int64())]))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text))
            if sum(map(len, held)) > chunk:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def sketches(docs: DataFrame, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, dk (hash of id and text), key (of the set), n, and for one document of a class in each
    task also prefix, cold (how many of these shingles aren't hot), bits and mins (the set's min-hashes)."""
    common = staged(_counted(docs).where(F.col("n") >= LATE_DOCS).orderBy(F.desc("n"), "token").limit(LATE), "common")
    listed = common.toArrow()
    tokens = listed.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    late = docs.sparkSession.sparkContext.broadcast((tokens[order], listed.column("n").to_numpy()[order] >= hot_docs))
    discard(common)
    schema = pa.schema([("doc_id", pa.int64()), ("dk", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("cold", pa.int32()), ("bits", pa.binary()), ("mins", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last, hot = late.value
        for batch in batches:
            rows = []
            for doc_id, dk, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = shingles(text)
                n, key = len(t), xxhash.xxh3_128_digest(t.tobytes())
                if not n or key in seen:
                    rows.append((doc_id, dk, key, n, None, None, None, None))
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                rank = np.zeros(n, np.int8)
                if len(last):
                    at = np.minimum(np.searchsorted(last, t), len(last) - 1)
                    rank = np.where(last[at] == t, 1 + hot[at], 0)
                cold, prefix = int((rank < 2).sum()), n - needed(n) + 1
                ordered = np.concatenate([t[rank == k] for k in range(3)])[:prefix]
                mins = (t[None, :] * _MIXERS[:MIN_HASHES, None]).min(axis=1)
                rows.append((doc_id, dk, key, n, ordered.view(np.int64), min(cold, prefix), bitmap(t), mins.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _dk().alias("dk"), "text")
    return source.mapInArrow(sketch, "doc_id long, dk long, key binary, n long, prefix array<long>, cold int, bits binary, mins array<long>")


def _dk() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _few_pairs(tile: np.ndarray, rid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_tile_pairs``, but each row meets only the next ``FEW`` of its tile, in an order that differs by tile."""
    order = np.lexsort(((rid.view(np.uint64) ^ tile.view(np.uint64)) * _K, tile))
    tile, rid, comp, n, pos = (x[order] for x in (tile, rid, comp, n, pos))
    at = [np.flatnonzero((tile[d:] == tile[:-d]) & (comp[d:] != comp[:-d])) for d in range(1, FEW + 1)]
    i, j = np.concatenate(at), np.concatenate([x + d for d, x in enumerate(at, 1)])
    yield _possible(rid, comp, n, pos, i, j)


def _possible(rid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (i, j), those of two components whose sizes and places let them link, once each."""
    room = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
    good = (comp[i] != comp[j]) & (room >= needed_overlap(n[i], n[j]))
    a, b = rid[i[good]], rid[j[good]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _tile_pairs(tile: np.ndarray, rid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of rows in one tile that may link and aren't connected; rows are sorted by tile, then n."""
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
    counts = np.diff(np.append(starts, len(tile)))
    mixed = (low != high) & (counts > 1)  # a tile of one component has nothing to compare
    small = np.repeat(mixed & (counts <= 64), counts)
    i, d = np.flatnonzero(small), 1
    while len(i):  # a row and the d-th after it
        i = i[i + d < len(tile)]
        j = i + d
        i = i[(tile[j] == tile[i]) & (100 * n[i] >= PERCENT * n[j])]
        yield _possible(rid, comp, n, pos, i, i + d)
        d += 1
    for k in np.flatnonzero(mixed & (counts > 64)):
        rows = np.arange(starts[k], starts[k] + counts[k])
        values, inverse, size = np.unique(comp[rows], return_inverse=True, return_counts=True)
        main = inverse == np.argmax(size)  # the largest component's rows meet only the others
        others, main = rows[~main], rows[main]
        for o, against in ((others, main), (others, others)):
            if not len(against):
                continue
            first = np.searchsorted(n[against], needed(n[o]))
            if against is others:  # once each: only those after it
                first = np.maximum(first, np.arange(1, len(o) + 1))
            many = np.maximum(np.searchsorted(n[against], n[o] * 100 // PERCENT + 1) - first, 0)
            ends, at = np.cumsum(many), 0
            while at < len(o):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                m = many[at:end]
                j = np.arange(m.sum()) + np.repeat(first[at:end] - np.cumsum(m) + m, m)
                yield _possible(rid, comp, n, pos, np.repeat(o[at:end], m), against[j])
                at = end


def _live(sketched: DataFrame) -> DataFrame:
    """tile, rid, n, pos, rows: a row for each shingle of a prefix, known hot ones aside, where the tile (of so many rows) holds another row of a size that fits."""
    rows = sketched.select("rid", F.col("n").cast("int").alias("n"), F.posexplode(F.expr("slice(prefix, 1, cold)")).alias("pos", "tile"))
    by = Window.partitionBy("tile").orderBy("n")
    fits = (100 * F.lag("n").over(by) >= PERCENT * F.col("n")) | (PERCENT * F.lead("n").over(by) <= 100 * F.col("n"))
    rows = rows.withColumns({"_fits": fits, "rows": F.count("*").over(Window.partitionBy("tile"))})
    return rows.where("_fits").select("tile", "rid", "n", "pos", "rows")


def _tiles(rows: DataFrame, choose: Callable = _tile_pairs) -> DataFrame:
    """a, b: candidate pairs of ``rows`` (tile, rid, comp, n, pos), chosen in each tile by ``choose``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in choose(*(rows[k] for k in range(5))):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy() for k in range(5)]))
            size += batch.num_rows
            if size < 200_000:
                continue
            joined = np.concatenate(held, axis=1)
            # the last tile may go on; where a row meets a few others, any will do
            cut = joined.shape[1] if choose is _few_pairs else np.searchsorted(joined[0], joined[0, -1])
            if cut:
                yield from give(joined[:, :cut])
            held, size = [joined[:, cut:]], joined.shape[1] - cut
        if held:
            yield from give(np.concatenate(held, axis=1))

    out = rows.select("tile", "rid", "comp", F.col("n").cast("long"), F.col("pos").cast("long"))
    return out.repartition("tile").sortWithinPartitions("tile", "n").mapInArrow(pairs, "a long, b long").distinct()


def _hot_pairs(rows: DataFrame, block: int = 4096) -> DataFrame:
    """a, b: candidate pairs in the tiles of hot shingles, of ``rows`` (tile, rid, comp, n, pos, bits).

    A tile is cut into bands of sizes, each at most a third above the one before, so linked
    sets lie in one band or in neighbours; a band meets itself and the one below. What lies
    in a band is dealt to blocks, and each row but those of the band's largest component
    visits all its blocks. A task holds one block and streams visitors past it: sizes, places
    and bitmaps are compared, and only pairs that all three let through are passed on.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3)) + 1e-9).cast("int")
    own = rows.withColumn("_own", band).withColumn("band", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    counts = own.groupBy("tile", "band", "comp").agg(F.count("*").alias("n"))
    bands = counts.groupBy("tile", "band").agg(F.sum("n").alias("_rows"), F.max(F.struct("n", "comp")).alias("_main"))
    bands = staged(bands.where("_rows > 1").select("tile", "band", "_rows", F.col("_main.comp").alias("_comp"), F.ceil(F.col("_rows") / block).cast("int").alias("_blocks")), "bands")
    dealt = lookup(own, bands, ["tile", "band"], "_rows").withColumn("main", F.col("comp") == F.col("_comp"))
    home = F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int")
    columns = ("tile", "band", "block", "visits", "rid", "comp", "n", "pos", "bits", "main", "own")
    dealt = dealt.withColumns({"own": F.col("_own") == F.col("band"), "visits": F.lit(0), "block": home})
    guests = dealt.where("not main").withColumn("visits", F.lit(1)).withColumn("block", F.explode(F.expr("sequence(0, _blocks - 1)")))
    both = dealt.select(*columns).union(guests.select(*columns))

    def words(bits: list[bytes], width: int) -> np.ndarray:
        """Bitmaps as rows of 64-bit words, folded to ``width`` bytes."""
        return np.stack([np.bitwise_or.reduce(np.frombuffer(b, "<u8").reshape(-1, width // 8), axis=0) for b in bits])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, h = None, [], {}
        for batch in batches:
            out_a, out_b = [], []
            for tile, band, block, visits, rid, comp, n, pos, bits, main, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tile, band, block) != group:
                    group, held, h = (tile, band, block), [], {}
                if not visits:
                    held.append((n, rid, comp, pos, main, own, bits))
                    continue
                if not held:
                    continue
                if not h:
                    held.sort(key=lambda x: x[:2])
                    width = min(len(x[6]) for x in held)
                    h = dict(zip(("n", "rid", "comp", "pos", "main", "own"), (np.array(x) for x in zip(*(y[:6] for y in held), strict=True)), strict=True)) | {"width": width, "bits": words([x[6] for x in held], width)}
                low, high = np.searchsorted(h["n"], [needed(n), n * 100 // PERCENT + 1])
                at = np.arange(low, high)
                need = needed_overlap(h["n"][at], n)
                room = 1 + np.minimum(h["n"][at] - h["pos"][at] - 1, n - pos - 1)
                at = at[(h["comp"][at] != comp) & (room >= need) & (h["own"][at] | own) & (h["main"][at] | (h["rid"][at] > rid))]
                if not len(at):
                    continue
                width = min(len(bits), h["width"])
                mine, theirs = words([bits], width)[0], h["bits"][at] if width == h["width"] else np.bitwise_or.reduce(h["bits"][at].reshape(len(at), -1, width // 8), axis=1)
                bound = np.minimum(n - np.bitwise_count(mine & ~theirs).sum(axis=1), h["n"][at] - np.bitwise_count(theirs & ~mine).sum(axis=1))
                at = at[bound >= needed_overlap(h["n"][at], n)]
                out_a += [rid] * len(at)
                out_b += h["rid"][at].tolist()
            if out_a:
                x = np.array([out_a, out_b], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], schema=schema)

    dealt = both.repartition("tile", "band", "block").sortWithinPartitions("tile", "band", "block", "visits")
    out = staged(dealt.mapInArrow(pairs, "a long, b long").distinct(), "hot-pairs")
    discard(bands)
    return out


def _bounded(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps let them reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap_bound(n, m, x, y) >= needed_overlap(n, m) for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=schema)

    side = lambda x: sketched.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, sketched: DataFrame, docs: DataFrame, repeats: bool, many: int = 256) -> DataFrame:
    """a, b: the pairs of rids that link, by intersecting their arrays; written.

    Only texts that occur in a pair are shuffled. A task gets a pair's first text once and
    streams the second ones past it; where a text has more than ``many`` pairs it is the
    first of them, dealt to several tasks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, group = None, None
        for batch in batches:
            links = []
            for a, salt, role, rid, key, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if role == 0 and (a, salt) == group:
                    continue
                t = shingles(text)
                if xxhash.xxh3_128_digest(t.tobytes()) != key:
                    continue  # another row with the same hash of id and text
                if role == 0:
                    first, group = t, (a, salt)
                elif group == (a, salt):
                    small, large = (t, first) if len(t) < len(first) else (first, t)
                    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * shared >= PERCENT * (len(t) + len(first) - shared):
                        links.append((a, rid))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=schema)

    pairs = staged(pairs.select("a", "b"), "pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b"))
    busy = ends.groupBy("rid").agg(F.count("*").alias("_n")).where(F.col("_n") > many)
    salted = pairs.select("a", "b", F.lit(0).alias("salt"))
    if not busy.isEmpty():
        busy = staged(busy, "busy")
        of = lambda x: busy.select(F.col("rid").alias(x), F.col("_n").alias(f"_{x}"), F.col("_n").alias("_w"))
        known = lookup(lookup(pairs, of("a"), ["a"], "_w", "left"), of("b"), ["b"], "_w", "left").fillna(0, ["_a", "_b"])
        a, b = F.when(F.col("_a") >= F.col("_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("_a") >= F.col("_b"), F.col("b")).otherwise(F.col("a"))
        parts = F.ceil(F.greatest("_a", "_b", F.lit(1)) / many)
        salted = staged(known.select(a.alias("a"), b.alias("b"), F.pmod(F.xxhash64(b), parts).cast("int").alias("salt")), "salted")
    wanted = salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("rid")).distinct().union(salted.select("a", "salt", F.lit(1), "b"))
    wanted = wanted.join(sketched.select("rid", "dk", "key"), "rid")
    needs = staged(ends.distinct().join(sketched.select("rid", "dk"), "rid").select("dk"), "needs")
    texts, on, working = may_be_in(docs.select(_dk().alias("dk"), "text"), F.col("dk"), needs)
    texts = texts.where(on).drop(*working).select("dk", "text")
    if repeats:
        texts = _once(texts)
    rows = wanted.join(texts, "dk").select("a", "salt", "role", "rid", "key", "text")
    out = staged(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(check, "a long, b long"), "found")
    discard(pairs, busy, salted, needs)
    return out


def _once(texts: DataFrame) -> DataFrame:
    """dk, text without what a task has passed on already: a row that repeats stays once a task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for dk in batch.column(0).to_pylist():
                new.append(dk not in seen)
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(dk)
            yield batch.filter(pa.array(new, pa.bool_()))

    return texts.mapInArrow(first, "dk long, text string")


def members(docs: DataFrame, *, hot_docs: int = HOT_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two written tables. The first: doc_id, dk (hash of id and text), n, key (of the set) for each row. The second:
    key, n_rows and root (a class that names its component) for each class that has words."""
    docs = docs.select("doc_id", "text")
    rows = staged(sketches(docs, hot_docs).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "dk"))
    classes = staged(rows.where("n > 0").groupBy("key").agg(F.min(F.when(F.col("prefix").isNotNull(), F.col("rid"))).alias("rid"), least.alias("first"), F.count("*").alias("n_rows")), "classes")
    held = rows.where("prefix is not null")
    extra = staged(held.join(classes.select("key", F.col("rid").alias("_rid")), "key").where("rid != _rid").select("rid"), "extra")
    sketched = staged(held.join(extra, "rid", "left_anti").drop("doc_id"), "classes-sketched")  # one row a class, and no join again
    out = staged(rows.select("doc_id", "dk", "key", "n"), "members")
    discard(rows, extra)
    repeats = not out.groupBy("dk").count().where("count > 1").isEmpty()
    # near copies: everyone against one document of its min-hash group, another one in each band
    bands = sketched.select("rid", "n", F.posexplode("mins").alias("band", "value"))
    pivots = bands.groupBy("band", "value").agg(F.min(F.struct(F.xxhash64("rid", "band").alias("h"), "rid", "n")).alias("p"), F.count("*").alias("_n")).where("_n > 1")
    pivots = staged(pivots.select("band", "value", F.col("p.rid").alias("a"), F.col("p.n").alias("_m"), "_n"), "pivots")
    near = lookup(bands, pivots, ["band", "value"], "_n").where(f"rid != a and 100 * least(n, _m) >= {PERCENT} * greatest(n, _m)").select("a", F.col("rid").alias("b")).distinct()
    links = [_verified(_bounded(near, sketched), sketched, docs, repeats)]
    comps = connected_components(links[0])
    # tiles of the rare shingles, leaving out what is connected: a few pairs of each row, then all that is left
    tiles = staged(_live(sketched), "live")
    live, warm = tiles.where(F.col("rows") <= hot_docs).drop("rows"), tiles.where(F.col("rows") > hot_docs)
    hot = sketched.where("size(prefix) > cold").select("rid", F.col("n").cast("int").alias("n"), "cold", "bits", F.posexplode("prefix").alias("pos", "tile"))
    hot = hot.where("pos >= cold").select("rid", "n", "bits", "pos", "tile")
    if not warm.isEmpty():
        hot = hot.union(warm.join(sketched.select("rid", "bits"), "rid").select("rid", "n", "bits", "pos", "tile"))
    hot = staged(hot, "hot")
    any_hot = not hot.isEmpty()
    passes = (_few_pairs, _tile_pairs) if any_hot or not live.isEmpty() else ()
    from_hot = None
    named = lambda x: x.join(comps, F.col("rid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rid")).drop("node", "root")
    for choose in passes:
        pairs = _tiles(named(live), choose)
        if any_hot and choose is _few_pairs:
            part = F.xxhash64("tile", F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(64)))  # a hot tile is dealt to 64 smaller ones
            pairs = pairs.union(_tiles(named(hot.drop("bits")).withColumn("tile", part), choose)).distinct()
        elif any_hot:
            from_hot = _hot_pairs(named(hot))
            pairs = pairs.union(from_hot).distinct()
        links.append(_verified(_bounded(pairs, sketched), sketched, docs, repeats))
        discard(from_hot)
        comps = extended_components(comps, links[-1])
    roots = classes.join(comps, F.col("rid") == F.col("node"), "left").select("key", "n_rows", "first", F.coalesce("root", "rid").alias("root"))
    roots = staged(roots, "roots")
    discard(sketched, classes, pivots, tiles, hot, comps, *links)
    return out, roots


def _class_names(roots: DataFrame) -> DataFrame:
    """key, n_rows and first (the component's least: no id, doc_id, dk) for each class; written."""
    names = staged(roots.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("_n")), "names")
    named = staged(lookup(roots.drop("first"), names, ["root"], "_n").select("key", "n_rows", "first"), "class-names")
    discard(names)
    return named


def jaccard_components(docs: DataFrame, *, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    rows, roots = members(docs, hot_docs=hot_docs)
    named = lookup(rows.where("n > 0"), _class_names(roots), ["key"], "n_rows")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return named.union(rows.where("n = 0").select("doc_id", F.col("n"), "doc_id"))


def one_of_each(docs: DataFrame, *, hot_docs: int = HOT_DOCS) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that with the smallest doc_id.

    Null ids come last, ties are settled by a hash of id and text. Documents without words stay.
    Only texts that may have to go are shuffled.
    """
    rows, roots = members(docs, hot_docs=hot_docs)
    names = _class_names(roots)
    judged = staged(lookup(rows.where("n > 0").select("dk", "key"), names, ["key"], "n_rows").select("dk", (F.col("dk") == F.col("first.dk")).alias("stays")), "judged")
    gone = staged(judged.where("not stays").select("dk").distinct(), "gone")
    again = staged(judged.where("stays").groupBy("dk").count().where("count > 1").select("dk"), "again")
    discard(judged, names, roots)
    own, on, working = may_be_in(packed(docs, _dk().alias("dk")), F.col("dk"), gone.union(again))
    own = own.withColumn("_maybe", on).drop(*working)
    out = own.where("not _maybe").select("row").union(own.where("_maybe").join(gone.union(again), "dk", "left_anti").select("row"))
    if not again.isEmpty():  # rows that repeat with the same id and text: one of them stays
        out = out.union(own.where("_maybe").join(again, "dk", "left_semi").groupBy("dk").agg(F.first("row").alias("row")).select("row"))
    return unpacked(out, docs.columns)
