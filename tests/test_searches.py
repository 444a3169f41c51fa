"""Text index and deep pages against plain scans and sorts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import paging, text_index

WORDS = ["alpha", "beta", "gamma", "delta", "Ünder", "a#1", "ab", "x"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """An index of three batches, more rows than a block of bitmaps holds."""
    r = random.Random(4)
    rows = [(i, None if i % 50 == 0 else " ".join(r.choices(WORDS, k=r.randint(0, 4))), [r.choice(WORDS)] if i % 3 else None) for i in range(40_000)]
    path = str(tmp_path_factory.mktemp("index") / "i")
    for part in (rows[:35_000], rows[35_000:39_999], rows[39_999:]):
        df = spark.createDataFrame(part, "id long, title string, artists array<string>")
        text_index.add(df, path, ["title", "artists"], "words")
    grams = path + "-grams"
    text_index.add(spark.createDataFrame(rows[:500], "id long, title string, artists array<string>"), grams, ["title"], "grams")
    text_index.add(spark.createDataFrame(rows[500:900], "id long, title string, artists array<string>"), grams, ["title"], "grams")
    return path, grams, rows


def test_words(spark, index):
    path, _, rows = index
    said = {i: set(((t or "").lower() + " " + " ".join(a or []).lower()).split()) for i, t, a in rows}
    for words, all_of in ((["alpha"], False), (["Alpha", "BETA", "ünder"], True), (["a#1", "gamma"], False), (["absent"], False), (["alpha", "absent"], True)):
        want = {w.lower() for w in words}
        got = [r.id for r in text_index.with_words(spark, path, words, all_of).collect()]
        assert sorted(got) == [i for i, s in said.items() if (want <= s if all_of else want & s)]


def test_parts_of_texts(spark, index):
    _, path, rows = index
    for part in ("pha", "A be", "a#1", "nder g", "ab", "", "zzz", "alpha beta gamma"):
        got = [r.id for r in text_index.containing(spark, path, part).collect()]
        assert sorted(got) == [i for i, t, _ in rows[:900] if t is not None and part.lower() in t.lower()]


def test_only_the_terms_folders_are_read(spark, index):
    path, _, _ = index
    found = text_index.postings(spark, path, "words", ["alpha"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(term,alpha)" in plan


def test_rare_terms_take_few_bytes(spark, tmp_path):
    """A word of each row and one of all: a bitmap holds 64 rows, so none takes kilobytes for a word that one row has."""
    path = str(tmp_path / "rare")
    text_index.add(spark.range(5000).select("id", F.format_string("all word%d", "id").alias("title")), path, ["title"], "words")
    found = text_index.postings(spark, path, "words", ["all", "word17"])
    assert found.dtypes[-2 if found.columns[-1] == "part" else -1] == ("bits", "bigint")
    assert {(r.term, r["count"]) for r in found.groupBy("term").count().collect()} == {("all", 79), ("word17", 1)}
    assert [r.id for r in text_index.with_words(spark, path, ["all", "word17"], True).collect()] == [17]


def test_a_term_of_all_rows_is_joined_as_bitmaps(spark, tmp_path):
    """40,000 rows that all hold the terms: the search joins a row for 64 numbers (before, one for each, which was broadcast)."""
    path = str(tmp_path / "all")
    rows = spark.range(40_000).select("id", F.format_string("all #0000%05d", "id").alias("title"))
    text_index.add(rows.where("id < 30000"), path, ["title"], "grams")
    text_index.add(rows.where("id >= 30000"), path, ["title"], "grams")
    assert text_index.having(spark, path, "grams", ["all", "000"]).count() == 626  # 40,000 / 64, numbers begin at 1
    found = text_index.containing(spark, path, "#00000123")
    assert "Generate" not in found._jdf.queryExecution().toString()
    assert sorted(r.id for r in found.collect()) == list(range(1230, 1240))


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    assert text_index.containing(spark, path, "abc").count() == 0
    text_index.add(spark.createDataFrame([], "id long, title string"), path, ["title"], "words")
    assert text_index.with_words(spark, path, ["a"]).count() == 0


@pytest.mark.parametrize("down", [False, True])
def test_pages(spark, tmp_path, down):
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), i) for i in range(333)]
    df = spark.createDataFrame(rows, "k int, id long")
    layout = paging.laid_out(df, [("k", down), ("id", False)], ranges=7, path=str(tmp_path / "p"))
    key = (lambda x: (x[0] is None, -(x[0] or 0), x[1])) if down else (lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = sorted(rows, key=key)
    for page, limit in ((1, 10), (2, 100), (34, 10), (33, 10), (9, 1), (99, 50)):
        assert [tuple(x) for x in paging.page_at(spark, layout, page, limit).orderBy(*layout.keys()).collect()] == want[(page - 1) * limit : page * limit]
    for at, limit in ((0, 5), (100, 200), (330, 10), (332, 5), (57, 1)):
        row = df.where(F.col("id") == want[at][1]).first()
        got = paging.page_after(spark, layout, paging.token(row, layout), limit)
        assert [tuple(x) for x in got.orderBy(*layout.keys()).collect()] == want[at + 1 : at + 1 + limit]
    some = paging.page_at(spark, layout, 20, 10)
    ranges = layout.ranges(spark).where("before < 200 and before + n > 190").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ranges <= 2 and ("PartitionFilters: [_range" in plan or "PartitionFilters: [isnotnull(_range" in plan)


def test_pages_of_nothing(spark, tmp_path):
    layout = paging.laid_out(spark.createDataFrame([], "k int, id long"), [("k", False)], 4, str(tmp_path / "p"))
    assert paging.page_at(spark, layout, 1, 10).collect() == [] and paging.page_after(spark, layout, "[null]", 10).collect() == []
