"""Conversation prefix trie: shared beginnings, and sums over subtrees by centroid decomposition.

Every conversation is a path from the root, a turn a step. A prefix is named by the sums of its
turns' digests, each digested again with its place, so names come from running totals and
one long conversation may lie in many tasks (``plans.prefix.running``). A node is known by its smallest
member and its depth; all nodes with one smallest member lie on that conversation's path.

``rolled_up`` adds values over subtrees. A component of the forest is split at its
centroid: the deepest node below which, with itself, at least half of the component's weight
lies. The component's total below the centroid is added to the nodes from the centroid up to the
component's top, the centroid is taken out, and what is left of the component above it and the
subtrees of its children are components of their own. Any node and a descendant are parted by one
centroid between them, so each value reaches each ancestor once, within as many levels as the weight
can be halved. Components of more than ``LOCAL`` nodes take a level together as DataFrames: totals
by partial aggregation, the path to the top from the centroid's own conversation, hot
components and conversations looked up by broadcast (``lookup``). All smaller components, whole, are split by
numpy in tasks, all components of a batch a level at a time.

Weights are turns of members (known when nodes are counted), reduced as subtrees are cut off. Digests of the
conversations that end at a node: groups within one partition of the sorted ids are hashed there; others,
however many ids they have, pass one task as text of ``CHUNK`` ids a row, since SHA-256 is sequential.

Defined cases: a null turn comes first; equal turns are ordered by a digest of role and text; null role or
text is empty; repeated rows are repeated turns; rows with a null conv_id belong to no conversation;
a conversation whose rebuilt form has no turns ends at the root; an empty table has no
conversation and gives an empty result; further columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.prefix import running
from marquee.plans.skew import lookup
from marquee.plans.staging import discard, staged

#: Nodes of a component that one task splits alone, at most.
LOCAL = 50_000
#: Nodes that a task takes at once, unless one component has more.
BATCH = 200_000
#: Ids in a row of text.
CHUNK = 200_000
_PIECES = ("_s0", "_s1", "_s2", "_s3")


def _four(digest: Column) -> dict[str, Column]:
    """128 bits of a hexadecimal digest as four longs below 2^32, whose sums stay within a long."""
    return {n: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k, n in enumerate(_PIECES)}


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_tie"))
    rows = staged(rows, "turns")  # so that the last column of the order stays as it is
    out = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_tie")], pos=F.lit(1))
    return out.select("conv_id", "pos", "digest", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first: (conv_id, pos, digest, bytes) and (conv_id, total) of all.

    A conversation c takes the first h turns of c - c % ``family`` and its own after its first h, h being the CRC-32 of its number in decimal, modulo ``most``.
    """
    turns = staged(turns, "numbered")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("_base_own")), "base", "left")
    taken = F.least("h", F.coalesce("_base_own", F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "h", "own", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("total")), "convs")
    own = lookup(turns, convs, ["conv_id"], "own").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "total")
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")  # below ``most`` rows a conversation
    lent = convs.select("conv_id", "base", "h", "total").join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "bytes", "total")
    rows = staged(own.unionByName(lent), "rebuilt")
    discard(turns)
    return rows, convs


def _members(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, bytes, total: each conversation at each prefix of at least one turn."""
    placed = rows.withColumns(_four(F.md5(F.concat_ws(":", "pos", "digest"))))
    summed = running(placed, "conv_id", [F.col("pos")], **{n + "_sum": F.col(n) for n in _PIECES})
    upto = [F.col(n + "_sum") for n in _PIECES]
    before = [F.col(n + "_sum") - F.col(n) for n in _PIECES]
    return summed.select("conv_id", F.col("pos").cast("long").alias("depth"), _name(F.col("pos").cast("long"), upto).alias("key"), _name(F.col("pos").cast("long") - 1, before).alias("parent"), "bytes", "total")


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(numbered_turns(conversations))
    members = staged(_members(rows), "members")
    discard(rows)
    root = _name(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    nodes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("total") - F.col("depth") + 1).alias("weight"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("total") + 1).alias("weight")).where("n_convs > 0")
    top = top.select(root.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"), "weight")
    nodes = staged(nodes.unionByName(top), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = staged(nodes.select("key", F.col("conv_id").alias("parent_conv_id")).join(children, "key").withColumnsRenamed({"key": "parent"}), "parents")
    named = lookup(nodes, parents.withColumn("_rows", F.col("n_children")).drop("n_children"), ["parent"], "_rows", "left")
    named = named.join(parents.select(F.col("parent").alias("key"), "n_children"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    named = staged(named.drop("parent"), "named")
    discard(nodes, parents)

    def paths() -> DataFrame:
        """conv_id, depth, owner, above: the smallest member of each node on a conversation's path, and of the node before it."""
        known = named.select("key", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("above"), "n_convs")
        below = lookup(members.select("conv_id", "depth", "key"), known, ["key"], "n_convs").select("conv_id", "depth", "owner", "above")
        first = named.where("depth = 0").first()["conv_id"]
        start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("owner"), F.lit(None).cast("long").alias("above"))
        return below.unionByName(start)

    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    sums = rolled_up(named.select("conv_id", "depth", "parent_conv_id", "weight", *[c.alias(n) for n, c in values.items()]), paths, list(values))
    ended = members.where("depth = total").select("key", "conv_id").unionByName(convs.where("total = 0").select(root.alias("key"), "conv_id"))
    out = named.join(sums, ["conv_id", "depth"]).join(end_digests(ended), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rolled_up(nodes: DataFrame, paths, values: list[str], local: int = LOCAL) -> DataFrame:
    """conv_id, depth and, for each of ``values``, its sum over the node's subtree.

    ``nodes`` is one tree: conv_id and depth (a node), parent_conv_id, weight (of the subtree) and ``values``; ``paths`` gives, where it is called for,
    the table conv_id, depth, owner, above of the nodes on each conversation's path.
    """
    comp = ["comp_conv", "comp_depth"]
    root = nodes.agg(F.min("conv_id")).first()[0]
    live = nodes.withColumns({"comp_conv": F.lit(root).cast("long"), **{c: F.lit(0).cast("long") for c in ("comp_depth", *[f"sum_{v}" for v in values])}})
    live, way, small, done = staged(live, "live"), None, [], []
    while True:
        is_top = (F.col("conv_id") == F.col("comp_conv")) & (F.col("depth") == F.col("comp_depth"))
        sizes = live.groupBy(*comp).agg(F.count("*").alias("n"), F.max(F.when(is_top, F.col("weight"))).alias("whole"))
        big = staged(sizes.where(F.col("n") > local), "big")
        if big.isEmpty():
            small.append(live)
            discard(big)
            break
        way = way or staged(paths(), "paths")
        small.append(staged(live.join(F.broadcast(big.select(*comp)), comp, "left_anti"), "small"))  # fewer than one in ``local`` nodes
        centroid = F.max(F.struct("depth", "conv_id", "weight"))
        whole = lookup(live, big, comp, "n")
        at = whole.where("2 * weight >= whole").groupBy(*comp).agg(centroid.alias("x"))
        at = at.select(*comp, F.col("x.depth").alias("x_depth"), F.col("x.conv_id").alias("x_conv"), F.col("x.weight").alias("x_weight"))
        at = staged(at.join(big.select(*comp, "n"), comp), "centroids")
        near = staged(lookup(live, at, comp, "n"), "near")
        # conversations with nodes below the centroid, and the child that they go through
        deep = near.where("depth > x_depth").groupBy(*comp, "conv_id", "x_conv", (F.col("x_depth") + 1).alias("depth")).agg(F.count("*").alias("rows"))
        under = deep.join(way, ["conv_id", "depth"]).where("above = x_conv").select(*comp, "conv_id", F.col("owner").alias("child"), "rows")
        under = staged(under, "under")
        near_under = lookup(near, under, [*comp, "conv_id"], "rows", "left")
        is_x = (F.col("conv_id") == F.col("x_conv")) & (F.col("depth") == F.col("x_depth"))
        below = F.col("child").isNotNull() & (F.col("depth") > F.col("x_depth"))
        near_under = staged(near_under.withColumns({"is_x": is_x, "below": below}), "parted")
        totals = near_under.where("is_x or below").groupBy(*comp).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        up = at.join(totals, comp).join(way.select(F.col("conv_id").alias("x_conv"), "depth", F.col("owner").alias("conv_id")), "x_conv").where("depth between comp_depth and x_depth")
        up = up.select("conv_id", "depth", F.col("x_weight").alias("less"), *[f"add_{v}" for v in values])
        new = near_under.join(up, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), *values,
            F.when(F.col("below"), F.col("child")).otherwise(F.col("comp_conv")).alias("comp_conv"), F.when(F.col("below"), F.col("x_depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
            *[(F.col(f"sum_{v}") + F.coalesce(f"add_{v}", F.lit(0))).alias(f"sum_{v}") for v in values], "is_x",
        )
        new = staged(new, "level")
        done.append(new.where("is_x").drop("is_x"))
        discard(live, big, at, near, under, near_under)
        live = new.where("not is_x").drop("is_x")
    rest = reduce(DataFrame.unionByName, small)
    names = ["conv_id", "depth", *values]
    solved = rest.repartition(*comp).sortWithinPartitions(*comp, "conv_id", "depth").mapInArrow(_solver(values), ", ".join(f"{n} long" for n in names))
    solved = reduce(DataFrame.unionByName, [solved, *[d.select("conv_id", "depth", *[F.col(f"sum_{v}").alias(v) for v in values]) for d in done]])
    return staged(solved, "sums")


def _solver(values: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) < BATCH:
                continue
            table = pa.concat_tables(held)
            ids = np.stack([table[c].to_numpy() for c in ("comp_conv", "comp_depth")])
            edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            if len(edges):  # the last component may go on
                yield _solved(table.slice(0, int(edges[-1])), values)
                table = table.slice(int(edges[-1]))
            held = [table]
        if held and (table := pa.concat_tables(held)).num_rows:
            yield _solved(table, values)

    return run


def _solved(table: pa.Table, values: list[str]) -> pa.RecordBatch:
    """Sums of whole components, sorted by component, conversation and depth."""
    col = {c: table[c].to_numpy() for c in ("comp_conv", "comp_depth", "conv_id", "depth")}
    above = table["parent_conv_id"].fill_null(0).to_numpy()
    new = np.concatenate([[True], (col["comp_conv"][1:] != col["comp_conv"][:-1]) | (col["comp_depth"][1:] != col["comp_depth"][:-1])])
    comp = np.cumsum(new) - 1
    chain = np.flatnonzero(np.concatenate([[True], new[1:] | (col["conv_id"][1:] != col["conv_id"][:-1])]))  # a conversation's nodes in a component have no gap
    parent = np.arange(-1, len(comp) - 1)
    convs = np.unique(col["conv_id"])
    code = comp[chain] * len(convs) + np.searchsorted(convs, col["conv_id"][chain])
    is_top = (col["conv_id"][chain] == col["comp_conv"][chain]) & (col["depth"][chain] == col["comp_depth"][chain])
    to = chain[~is_top]
    home = chain[np.searchsorted(code, comp[to] * len(convs) + np.searchsorted(convs, above[to]))]
    parent[to] = home + col["depth"][to] - 1 - col["depth"][home]
    parent[chain[is_top]] = -1
    given = np.stack([table[v].to_numpy() for v in values], 1)
    sums = centroid_sums(parent, col["depth"], given) + np.stack([table[f"sum_{v}"].to_numpy() for v in values], 1)
    return pa.RecordBatch.from_arrays([pa.array(col["conv_id"]), pa.array(col["depth"]), *[pa.array(np.ascontiguousarray(sums[:, k])) for k in range(len(values))]], ["conv_id", "depth", *values])


def centroid_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over all subtrees of a forest; ``parent`` is a place or -1, and lies less deep than its child."""
    n = len(parent)
    order = np.argsort(depth, kind="stable").tolist()
    up, size, place = parent.tolist(), [1] * n, [0] * n
    for v in reversed(order):
        if up[v] >= 0:
            size[up[v]] += size[v]
    free, roots = [0] * n, 0
    for v in order:  # places in preorder, so that a subtree is a range
        if up[v] < 0:
            place[v], roots = roots, roots + size[v]
        else:
            place[v], free[up[v]] = free[up[v]], free[up[v]] + size[v]
        free[v] = place[v] + 1
    at = np.array(place, np.int64)
    above, weight, given = np.full(n, -1), np.zeros(n, np.int64), np.zeros_like(values)
    above[at[parent >= 0]] = at[parent[parent >= 0]]
    weight[at], given[at] = size, values
    live = np.arange(n)
    end = live + weight
    comp = np.maximum.accumulate(np.where(above < 0, live, 0))  # the top of each node's component
    sums, centre = np.zeros_like(values), np.zeros(n, np.int64)
    while len(live):
        half = live[2 * weight[live] >= weight[comp[live]]]  # from the top down to the centroid
        centre[comp[half]] = half
        x = centre[comp[live]]
        below, path = (live >= x) & (live < end[x]), (live <= x) & (x < end[live])
        total = np.zeros_like(values)
        np.add.at(total, x[below], given[live[below]])
        sums[live[path]] += total[x[path]]
        less = weight[x[path]]
        weight[live[path]] -= less
        kids = live[above[live] >= 0]
        kids = kids[centre[comp[kids]] == above[kids]]
        code = np.sort(above[kids] * n + kids)
        low = below & (live != x)
        comp[live[low]] = code[np.searchsorted(code, x[low] * n + live[low], "right") - 1] % n
        live = live[live != x]
    return sums[at]


def end_digests(ended: DataFrame) -> DataFrame:
    """key, ends_sha256: of the decimal ids (conv_id) of each key, ascending, joined by commas."""
    placed = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id", F.spark_partition_id().alias("part"))
    rows = staged(placed.mapInArrow(_first_digests, "key binary, part int, place int, ids string, ends_sha256 string"), "ends")
    long = rows.where("ids is not null").select("key", "part", "place", "ids").repartition("key").sortWithinPartitions("key", "part", "place")
    return rows.where("ids is null").select("key", "ends_sha256").unionByName(long.mapInArrow(_long_digests, "key binary, ends_sha256 string"))


def _first_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of groups that lie whole in this partition; text rows of long ones, and of the first and last, which may lie in others too."""
    key, part, place, ids, first, out = None, 0, 0, [], True, []
    row = lambda text, digest: (key, part, place, text, digest)
    for b in batches:
        for k, c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if ids:
                    text = ",".join(map(str, ids))
                    out.append(row(text, None) if first or place else row(None, hashlib.sha256(text.encode()).hexdigest()))
                    first = False
                key, ids, place = k, [], 0
            elif len(ids) == CHUNK:
                out.append(row(",".join(map(str, ids)), None))
                ids, place = [], place + 1
            ids.append(c)
            if len(out) == 1000 or out and place:
                yield _ended(out)
                out = []
    if ids:
        out.append(row(",".join(map(str, ids)), None))
    if out:
        yield _ended(out)


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    key, part, place, ids, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(ids, pa.string()), pa.array(digest, pa.string())], ["key", "part", "place", "ids", "ends_sha256"])


def _long_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of text rows, a key after the other."""
    key, state, out = None, None, []
    for b in batches:
        for k, text in zip(b.column(0), b.column(3), strict=True):
            k = k.as_py()
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
    if state is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["key", "ends_sha256"])
