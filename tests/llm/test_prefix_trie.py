"""Prefix trie against a plain version with tuples of turns."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from marquee.llm import prefix_trie
from marquee.llm.queries import QUERIES


def plain(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()) for p, m in members.items()]


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def odd():
    """Nulls, ties, negative ids, two long conversations that share all but their ends, repeated rows, many equal conversations."""
    r, rows = random.Random(5), []
    for c in range(-7, 60):
        for t in range(r.choice([0, 1, 3, 7, 12])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, "c"])))
    rows += [(None, 1, "user", "x")] + [(200, t, "user", str(t % 3)) for t in range(300)] + [(201, t, "user", str(t % 3)) for t in range(305)]
    return rows + [(900, None, "u", "same")] * 40 + [(c, 1, "user", "hello") for c in range(1000, 1200)]


@pytest.mark.parametrize(("local", "chunk"), [(prefix_trie.LOCAL, prefix_trie.CHUNK), (25, prefix_trie.CHUNK)])
def test_odd_conversations(spark, monkeypatch, odd, local, chunk):
    """With components of 25 nodes at most in a task, the first levels are taken as DataFrames."""
    rolled = prefix_trie.rolled_up
    monkeypatch.setattr(prefix_trie, "rolled_up", lambda n, p, v: rolled(n, p, v, local))
    df = spark.createDataFrame([(*row, 1) for row in odd], "conv_id long, turn long, role string, text string, depth int")
    assert _sorted(prefix_trie.trie(df).collect()) == _sorted(plain(odd))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert _sorted(QUERIES["op12_prefix_trie"](spark, sf).collect()) == _sorted(plain(rows))


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_digests_of_long_groups(monkeypatch):
    """Groups over several partitions and rows of text give the digest of all their ids."""
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    groups = {b"a": list(range(3)), b"b": list(range(10, 60)), b"c": [5], b"d": list(range(100, 107)), b"e": [1, 2]}
    ids = [(k, c) for k, v in groups.items() for c in v]
    rows = []
    for part, (start, end) in enumerate([(0, 20), (20, 41), (41, len(ids))]):
        k, c = zip(*ids[start:end], strict=True)
        batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 4], pa.binary()), pa.array(c[i : i + 4]), pa.array([part] * len(k[i : i + 4]), pa.int32())], ["key", "conv_id", "part"]) for i in range(0, len(k), 4)]
        for b in prefix_trie._first_digests(iter(batches)):
            rows += b.to_pylist()
    got = {r["key"]: r["ends_sha256"] for r in rows if r["ids"] is None}
    long = sorted((r["key"], r["part"], r["place"], r["ids"]) for r in rows if r["ids"] is not None)
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in long]) for i in range(4)], ["key", "part", "place", "ids"])
    got |= {r["key"]: r["ends_sha256"] for b in prefix_trie._long_digests(iter([batch])) for r in b.to_pylist()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in groups.items()}


def test_centroid_sums():
    """Chains, stars and random forests, and no more levels than the logarithm of their nodes."""
    r = np.random.default_rng(2)
    for parent in ([-1], list(range(-1, 500)), [-1] + [0] * 300, [-1, -1, 0, 1, 1, 3], [-1, *[int(r.integers(max(0, i - 9), i)) for i in range(1, 2000)]]):
        parent = np.array(parent)
        depth = np.zeros(len(parent), np.int64)
        for v in range(len(parent)):
            depth[v] = depth[parent[v]] + 1 if parent[v] >= 0 else 0
        values = r.integers(0, 100, (len(parent), 2))
        want = values.copy()
        for v in range(len(parent) - 1, 0, -1):
            if parent[v] >= 0:
                want[parent[v]] += want[v]
        assert (prefix_trie.centroid_sums(parent, depth, values) == want).all()
