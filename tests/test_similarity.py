"""Similarity in SQL against the plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marquee.functions.similarity import jaro_winkler, pair_likeness, text_similarity
from marquee.queries import QUERIES
from tests.plain_similarity import folded, winkler


def test_random_texts(spark):
    """Short and long texts, code points beyond the basic plane, blanks, case, equal, empty and null ones."""
    r = random.Random(8)
    some = lambda: "".join(r.choice("abcAB é😀ßΣ ") for _ in range(r.choice([0, 1, 2, 5, 9, 20, 70, 150])))
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"), ("", ""), ("abc", ""), (None, "a"), (None, None), ("x" * 500, "x" * 499 + "y"), ("ab", "ba")]
    for _ in range(250):
        a = some()
        b = some() if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.8) + r.choice(["", "z"])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    for row in df.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("w"), text_similarity(F.col("a"), F.col("b")).alias("t")).collect():
        if row.a is None or row.b is None:
            assert row.w is None and row.t is None
            continue
        assert abs(row.w - winkler(row.a, row.b)) < 1e-12, row
        assert abs(row.t - folded(row.a, row.b)) < 1e-12, row


def test_no_python_workers(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(jaro_winkler(F.col("a"), F.col("b")), text_similarity(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_pairs_of_parts(spark):
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    want = {(x.p_partkey, y.p_partkey): winkler(f"{x.p_type} {x.p_name}", f"{y.p_type} {y.p_name}") for x in parts for y in parts if x.p_partkey < y.p_partkey and (x.p_brand, x.p_size) == (y.p_brand, y.p_size)}
    got = {(r.a, r.b): r.score for r in QUERIES["jaro_winkler_pairs"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_many_pairs(spark):
    """The numpy version on random texts, from both sides, long ones and those that are equal, empty or null."""
    r = random.Random(9)
    some = lambda: "".join(r.choice("abcAB é😀ßΣ ") for _ in range(r.choice([0, 1, 2, 5, 9, 20, 70])))
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("", ""), ("abc", ""), (None, "a"), (None, None), ("x" * 3000, "x" * 2999 + "y"), ("ab", "ba"), ("\uffffa", "\uffffb")]
    for _ in range(600):
        a = some()
        pairs.append((a, some() if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.8) + r.choice(["", "z"])))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(2)
    for row in df.select("a", "b", pair_likeness(F.col("a"), F.col("b")).alias("w"), pair_likeness(F.col("b"), F.col("a")).alias("v")).collect():
        want = None if row.a is None or row.b is None else winkler(row.a, row.b)
        assert row.w == row.v == want, row


def test_copies_of_parts(spark, tmp_path):
    """Parts of one text give their own pair with the first of them, not all pairs; those of other texts are met once."""
    names = ["red", "red", "blue", "red", "blue", "green"]
    spark.createDataFrame([(10 - i, n, "B", "T", 1) for i, n in enumerate(names)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b): (r.score, r.copy) for r in QUERIES["jaro_winkler_pairs"](spark, str(tmp_path)).collect()}
    like = lambda x, y: (round(winkler(f"T {x}", f"T {y}"), 6), False)
    assert got == {(7, 9): (1.0, True), (7, 10): (1.0, True), (6, 8): (1.0, True), (6, 7): like("blue", "red"), (5, 6): like("green", "blue"), (5, 7): like("green", "red")}
