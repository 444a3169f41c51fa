"""Connected components of a link table, with everything distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.skew import lookup
from marquee.plans.staging import discard, staged


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable over ``links`` (a, b), for all nodes that have a link.

    Each round every node points to its smallest neighbour, pointers are followed to
    their ends by doubling, and links are redrawn between those ends. Local minima at
    least halve, so rounds, and doublings within one, grow with the logarithm of the
    nodes. Every step is written to the shared folder; the driver sees only whether a
    step changed anything. A node with millions of links costs one partial minimum a task,
    and a root that many nodes point to is looked up by broadcast (``lookup``).
    """
    links = links.select("a", "b").where("a is not null and b is not null and a != b")
    links = staged(links.distinct(), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        up = staged(up.select("node", F.least("node", "root").alias("root")), "up")
        while True:
            next_up = up.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            heads = staged(up.groupBy("root").agg(F.count("*").alias("_rows")).join(next_up, "root"), "heads")
            if heads.where("_r != root").isEmpty():
                discard(heads)
                break
            jumped = staged(lookup(up, heads, ["root"], "_rows").select("node", F.col("_r").alias("root")), "jump")
            discard(up, heads)
            up = jumped
        to = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = up if roots is None else staged(_renamed(roots, up), "roots")
        ends = links.join(to, F.col("a") == F.col("_n")).select(F.col("_r").alias("a"), "b")
        ends = ends.join(to, F.col("b") == F.col("_n")).select("a", F.col("_r").alias("b"))
        fewer = staged(ends.where("a != b").distinct(), "links")
        discard(links, *([] if roots is None else [up, roots]))
        links, roots = fewer, new
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(links)
    return roots


def _renamed(roots: DataFrame, to: DataFrame) -> DataFrame:
    """``roots`` (node, root) with each root that is a node of ``to`` replaced by its root there."""
    new = to.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return roots.join(new, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))


def extended_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comps`` (as ``connected_components`` gives them, written) with more ``links``; both are deleted where a new table takes their place.

    Only links between different components count, and only their roots are connected anew.
    """
    if links.isEmpty():
        return comps
    end = lambda x: comps.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    named = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    across = named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a != b")
    across = staged(across.distinct(), "across")
    if across.isEmpty():
        discard(across)
        return comps
    more = connected_components(across)
    fresh = more.join(comps.select(F.col("node").alias("_known")), F.col("node") == F.col("_known"), "left_anti")
    out = staged(_renamed(comps, more).union(fresh.select("node", "root")), "roots")
    discard(across, more, comps)
    return out
