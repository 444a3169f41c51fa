"""Search over several shards and cells, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from marquee.llm import ann


def brute(vectors, query, k):
    scores = sorted((-float((v * vectors[query]).sum()), i) for i, v in vectors.items() if i != query)
    return [(i, -s) for s, i in scores[:k]]


@pytest.mark.parametrize(("scale", "clusters"), [(1.0, 0), (1e20, 0), (1e-20, 12)])
def test_recall_over_shards(spark, scale, clusters):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24)) + (8 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 4000)] if clusters else 0)
    x[1000:1400] = x[0]  # a vector that a tenth of all rows share
    vectors = {i: v.astype(np.float32).astype(float) * scale for i, v in enumerate(x)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(4)
    index = ann.build_index(rows, shard_rows=400)
    assert index.count() >= 10
    got = defaultdict(list)
    for r in ann.search(index, rows.where("vec_id % 100 = 0"), k=20, first_cells=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 4000, 100):
        want = brute(vectors, q, 20)
        hit += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0])) and len(got[q]) == 20
        for i, s in got[q]:
            assert s == pytest.approx(float((vectors[i] * vectors[q]).sum()), rel=1e-12)
    assert hit >= 0.95 * 20 * 40
    # ties over shards go to the smallest ids
    assert [i for i, _ in got[1000] if i in range(1000, 1400) or i == 0] == [i for i, _ in brute(vectors, 1000, 20) if i in range(1000, 1400) or i == 0]


def test_queries_of_another_length(spark):
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(1, 30)], "vec_id long, embedding array<double>")
    index = ann.build_index(rows)
    others = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r["query_id"] for r in ann.search(index, others, k=3).collect()} == {3}
