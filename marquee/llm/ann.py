"""Approximate nearest neighbours: a navigable small-world graph per shard, merged results.

Vectors are dealt to cells by their nearest centre (k-means on ``FIT_ROWS`` of them at most,
``CELLS`` centres at most) and, within a cell, to shards of about ``shard_rows`` by a hash of their
id, so a cell that holds most vectors is many shards, each at most half above ``shard_rows``. A shard's
graph has levels: level 0 holds every distinct vector, each level above a pseudo-random
sixteenth of the one below. A node's neighbours are chosen among its nearest on the level (found
exactly, in blocks, as a shard is small) by the usual diversity rule, topped up with
the nearest that the rule passed over, and links go both ways. The graph is stored
as flat neighbour arrays, a row a shard. Inner product is turned into distance by one
more coordinate that gives all vectors the same length.

Search walks all levels of a shard for blocks of queries at a time, keeps ``ef`` candidates,
scores what it found again in double precision on the original vectors, and merges the
shards' best. A query first meets the cells with the largest possible inner product (that of
the centre plus the query's length times the cell's radius), then every other cell whose bound
isn't below the ``k``-th score found: cells left out can't hold a nearer vector. Where vectors
have no clusters the bound excludes little, and queries times shards are met.

Equal vectors of a shard are one node with all ids in order, so a vector that a third of
all rows share neither breaks the graph nor fills a task's results. A shard is bounded,
so build and search memory are; shards, and (query, shard) results, grow with the input.

Vectors are divided by their largest component before single precision is used, so any
finite ones do.

Defined cases: vectors that are null, empty, zero, hold a null or non-finite component, or
whose length isn't the most common one take no part; neither do rows with a null id. Queries
whose length isn't that of the index get no rows. Ties go to the smaller
id; of rows that repeat an id the smallest vector in array order counts; fewer candidates
than ``k`` are all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.staging import discard, staged


CELLS = 256
#: Vectors that the cells' centres are fitted on, at most.
FIT_ROWS = 20_000


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part, one for each id; of length ``dim`` or the most common one."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall("embedding", lambda v: v == 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & ~zero)
    if dim is None:
        common = x.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = common["n"] if common else 0
    return x.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centres at most of the rows of ``x`` by k-means."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(3).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = _cell(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _nearest(x: np.ndarray, n: int, block: int = 512) -> np.ndarray:
    """For each row the ``n`` nearest other rows by distance, nearest first."""
    norms, out = (x * x).sum(axis=1), np.empty((len(x), n), np.int32)
    for at in range(0, len(x), block):
        d = norms - 2 * (x[at : at + block] @ x.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.argsort(d, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        out[at : at + block] = np.take_along_axis(near, order, axis=1)
    return out


def _links(x: np.ndarray, m: int) -> np.ndarray:
    """Flat neighbour array (rows, 2m) of one level; -1 where a row has fewer."""
    n = len(x)
    out = np.full((n, 2 * m), -1, np.int32)
    if n < 2:
        return out
    near = _nearest(x, min(3 * m, n - 1))
    kept = np.zeros(near.shape, bool)
    for at in range(0, n, 256):  # diversity: keep a candidate nearer to the row than to any kept before it
        ids = near[at : at + 256]
        y, own = x[ids], x[at : at + 256]
        to_own = ((y - own[:, None]) ** 2).sum(axis=2)
        sq = (y * y).sum(axis=2)
        among = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        keep = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            near_kept = np.where(keep, among[:, j, :], np.inf).min(axis=1)
            keep[:, j] = (to_own[:, j] < near_kept) & (keep.sum(axis=1) < m)
        kept[at : at + 256] = keep
    rank = np.where(kept, np.arange(near.shape[1]), near.shape[1] + np.arange(near.shape[1]))  # kept ones first, then the passed over
    own = np.take_along_axis(near, np.argsort(rank, axis=1), axis=1)[:, :m]
    out[:, : own.shape[1]] = own
    # links back, as far as room is left
    src, dst = np.repeat(np.arange(n), own.shape[1]), own.ravel()
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = place < 2 * m - own.shape[1]
    out[dst[fits], own.shape[1] + place[fits]] = src[fits]
    return out


def build_shard(ids: np.ndarray, x: np.ndarray, m: int, seed: int = 7) -> dict:
    """A shard's graph: distinct vectors, their ids and each level's nodes and neighbours."""
    x, inverse = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, inverse.ravel()))
    ids, inverse = ids[order], inverse.ravel()[order]
    mix = np.random.default_rng(seed).permutation(len(x))
    y = x / np.abs(x).max()
    norms = (y * y).sum(axis=1)
    lifted = np.concatenate([y, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    levels, nodes = [], np.arange(len(x))
    while True:
        levels.append((nodes.astype(np.int32), _links(lifted[nodes], m)))
        if len(nodes) <= 64:
            break
        nodes = np.sort(nodes[np.argsort(mix[nodes])[: max(1, len(nodes) // 16)]])
    return {"vectors": x, "ids": ids, "starts": np.searchsorted(inverse, np.arange(len(x) + 1)), "levels": levels}


def search_shard(shard: dict, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (queries, ef; -1 for none) with the largest inner products found, and these."""
    x = (shard["vectors"] / np.abs(shard["vectors"]).max()).astype(np.float32)
    q = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
    nodes, _ = shard["levels"][-1]
    start = nodes[np.argsort(-(q @ x[nodes].T), axis=1)[:, :8]]  # the top level is small enough to see whole
    for depth in range(len(shard["levels"]) - 1, -1, -1):
        nodes, links = shard["levels"][depth]
        width = ef if depth == 0 else min(16, len(nodes))
        local = np.searchsorted(nodes, start)
        found, scores = _walk(x[nodes], links, q, local, width)
        start = np.where(found[:, :8] >= 0, nodes[found[:, :8]], start[:, :1])
    return found, scores


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walk on one level for all queries at once; the best ``ef`` nodes, best first."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # stands for no neighbour
    best, score = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)

    def offer(ids: np.ndarray, live: np.ndarray) -> None:
        nonlocal best, score, done
        at = np.arange(len(live))[:, None]
        new = ~seen[live[:, None], ids]
        order = np.argsort(ids, axis=1, kind="stable")  # an id twice in a row counts once
        same = np.zeros(ids.shape, bool)
        ordered = np.take_along_axis(ids, order, axis=1)
        same[at, order[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
        new &= ~same
        seen[live[:, None], ids] = True
        s = np.where(new, np.einsum("qd,qkd->qk", q[live], x[np.minimum(ids, len(x) - 1)]), -np.inf).astype(np.float32)
        a, b, c = np.concatenate([best[live], ids], 1), np.concatenate([score[live], s], 1), np.concatenate([done[live], ~new], 1)
        top = np.argpartition(-b, ef - 1, axis=1)[:, :ef] if b.shape[1] > ef else np.argsort(-b, axis=1)[:, :ef]
        best[live], score[live], done[live] = a[at, top], b[at, top], c[at, top]

    offer(start, np.arange(n))
    live = np.arange(n)
    while len(live):
        s = np.where(done[live], -np.inf, score[live])
        pick = np.argpartition(-s, 1, axis=1)[:, :2] if ef > 2 else np.argmax(s, axis=1)[:, None]  # two nodes a step
        at = np.arange(len(live))[:, None]
        good = s[at, pick] > -np.inf
        live, pick, good = live[good.any(axis=1)], pick[good.any(axis=1)], good[good.any(axis=1)]
        if not len(live):
            break
        nodes = best[live[:, None], pick]
        done[live[:, None], pick] = True
        near = np.where(good[:, :, None], links[nodes], -1).reshape(len(live), -1)
        offer(np.where(near < 0, len(x), near), live)
    order = np.argsort(-score, axis=1, kind="stable")
    best, score = best[rows, order], score[rows, order]
    return np.where(np.isfinite(score), best, -1), score


_INDEX = "shard long, cell int, n long, dim int, centre binary, radius double, vectors binary, ids binary, starts binary, level_sizes array<int>, nodes binary, neighbours binary"


def build_index(vectors: DataFrame, *, shard_rows: int = 8192, m: int = 16) -> DataFrame:
    """One row a shard: its cell's centre and the shard's radius about it, vectors, ids and the graph as flat arrays; written."""
    x = staged(usable(vectors), "vectors")
    n = x.count()
    drawn = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow() if n > shard_rows else None
    scale, centres = 1.0, None
    if drawn is not None:
        sample = np.stack(drawn.column(0).to_numpy())
        scale = float(np.abs(sample).max())
        centres = _centres(sample / scale, min(CELLS, max(1, round(n / shard_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                cell = _cell(values / scale, centres) if centres is not None else np.zeros(len(values), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["vec_id", "embedding", "cell"])

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values, cell = np.stack(part["embedding"].to_numpy()), int(part["cell"].iloc[0])
        g = build_shard(part["vec_id"].to_numpy(np.int64), values, m)
        centre = centres[cell] * scale if centres is not None else np.zeros(values.shape[1])
        top = np.abs(values - centre).max() or 1.0
        radius = float(np.sqrt((((values - centre) / top) ** 2).sum(axis=1)).max() * top)
        return pd.DataFrame([{
            "shard": int(key[0]), "cell": cell, "n": len(g["vectors"]), "dim": g["vectors"].shape[1], "centre": centre.tobytes(), "radius": radius, "vectors": g["vectors"].tobytes(), "ids": g["ids"].tobytes(), "starts": g["starts"].astype(np.int64).tobytes(),
            "level_sizes": [len(n) for n, _ in g["levels"]], "nodes": b"".join(n.tobytes() for n, _ in g["levels"]), "neighbours": b"".join(k.tobytes() for _, k in g["levels"]),
        }])

    placed = staged(x.mapInArrow(place, "vec_id long, embedding array<double>, cell int"), "placed")
    parts = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.round(F.count("*") / shard_rows)).cast("int").alias("_parts"))  # a row a cell, CELLS at most
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("_parts")) * CELLS + F.col("cell"))
    index = staged(dealt.drop("_parts").groupBy("shard").applyInPandas(build, _INDEX), "index")
    discard(x, placed)
    return index


def load_shard(row: dict) -> dict:
    """A shard as ``build_shard`` makes it, from its row of the index."""
    sizes = list(row["level_sizes"])
    nodes, links = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["neighbours"], np.int32).reshape(sum(sizes), -1)
    cuts = np.cumsum(sizes)[:-1]
    return {"vectors": np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"]), "ids": np.frombuffer(row["ids"], np.int64), "starts": np.frombuffer(row["starts"], np.int64), "levels": list(zip(np.split(nodes, cuts), np.split(links, cuts), strict=True))}


def search(index: DataFrame, queries: DataFrame, *, k: int = 20, ef: int = 128, block: int = 256, first_cells: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, embedding) its ``k`` best, itself left out.

    Each block of queries that meets a shard is a row of one task.
    """
    dims = index.agg(F.max("dim")).first()[0]
    q = staged(usable(queries, dims or 0), "queries")
    cells = index.groupBy("cell").agg(F.first("centre").alias("centre"), F.max("radius").alias("radius")).orderBy("cell").collect()  # CELLS at most
    numbers = np.array([c["cell"] for c in cells], np.int32)
    centres = np.array([np.frombuffer(c["centre"]) for c in cells]).reshape(len(cells), dims or 0)
    radius = np.array([c["radius"] for c in cells])

    def route(rest: bool):
        """Cells of each query: the first ones, or all others that may hold a better vector than ``least``."""

        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                top = np.abs(x).max(axis=1, keepdims=True)
                bound = (x / top) @ centres.T + np.sqrt(((x / top) ** 2).sum(axis=1))[:, None] * radius
                order = np.argsort(-bound, axis=1, kind="stable")
                if rest:
                    least = batch.column(2).to_numpy(zero_copy_only=False)[:, None] / top
                    slack = 1e-9 * np.abs(bound).max(axis=1, keepdims=True)
                    own = [o[first_cells:][ok[o[first_cells:]]] for o, ok in zip(order, bound + slack >= least, strict=True)]
                else:
                    own = order[:, :first_cells]
                row = np.repeat(np.arange(len(x)), [len(o) for o in own])
                cell = numbers[np.concatenate(own)] if len(row) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell, pa.int32())], names=["vec_id", "embedding", "cell"])

        return cells_of

    def best(routed: DataFrame) -> DataFrame:
        routed = staged(routed.join(index.select("cell", "shard"), "cell"), "routed")
        counts = routed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
        dealt = routed.join(counts, "shard").groupBy("shard", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).alias("_block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
        shards = index.select(F.col("shard").alias("_shard"), F.struct("n", "dim", "vectors", "ids", "starts", "level_sizes", "nodes", "neighbours").alias("index"))
        found = dealt.join(shards, F.col("shard") == F.col("_shard")).select("index", "queries").mapInArrow(run, "query_id long, vec_id long, score double")
        return _top(found, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                g = load_shard(one["index"])
                ids, x = np.array([r["vec_id"] for r in one["queries"]], np.int64), np.array([r["embedding"] for r in one["queries"]], float)
                found, _ = search_shard(g, x, min(ef, max(len(g["vectors"]), 1)))
                out = [_exact(g, i, v, f[f >= 0], k) for i, v, f in zip(ids, x, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(o[0]), i) for i, o in zip(ids, out, strict=True)]), pa.int64()), pa.array(np.concatenate([o[0] for o in out]), pa.int64()), pa.array(np.concatenate([o[1] for o in out]))], schema=schema)

    routed = "vec_id long, embedding array<double>, cell int"
    near = staged(best(q.mapInArrow(route(False), routed)), "near")
    if len(cells) <= first_cells:
        return near
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    more = q.join(least, "vec_id", "left").select("vec_id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    far = best(more.mapInArrow(route(True), routed))
    return _top(near.drop("rank").unionByName(far.drop("rank")), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(g: dict, query_id: int, query: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` ids of the nodes, by the inner product in double precision, ties to smaller ids."""
    scores = (g["vectors"][nodes] * query).sum(axis=1)
    order = np.argsort(-scores, kind="stable")
    ids, values, n = [], [], 0
    for node, s in zip(nodes[order], scores[order], strict=True):
        if n >= k and s < values[-1][0]:  # nodes that tie with the last may hold smaller ids
            break
        own = g["ids"][g["starts"][node] : min(g["starts"][node + 1], g["starts"][node] + k + 1)]
        own = own[own != query_id][:k]
        ids.append(own)
        values.append(np.full(len(own), s)) if len(own) else ids.pop()
        n += len(own)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    i, s = np.concatenate(ids), np.concatenate(values)
    order = np.lexsort((i, -s))[:k]
    return i[order], s[order]
