"""Callers' columns whose names clash with working columns, and tables with odd rows, in every stage of the pipeline."""

import pytest

from marquee.llm import jaccard, mixing, quality_rules, secrets

NAMES = ("n_words", "kept", "row", "_lines", "_hits", "hits", "_dk", "dk", "_own", "_size", "words", "tie", "_words", "_id", "_found", "found", "rid", "taken", "all", "_at", "_bits", "_maybe", "key")
TEXT = "\n".join(f"Line {k} tells number {k + 100} of a long story about towns{k} and rivers{k}." for k in range(8))
STAGES = {"quality": quality_rules.cleaned, "copies": jaccard.one_of_each, "secrets": secrets.redacted, "mixture": mixing.mixed_documents}


def table(spark, rows):
    columns = ", ".join(f"`{n}` {'string' if k % 2 else 'int'}" for k, n in enumerate(NAMES))
    extra = [f"x{k}" if k % 2 else k for k in range(len(NAMES))]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, n_chars long, {columns}")


@pytest.mark.parametrize("name", STAGES)
def test_columns_pass_untouched(spark, name):
    rows = [(1, TEXT, "a", 3), (2, TEXT + " Another end.", "b", 3), (3, 'set token = "7c72db563d7f6e50cec00950f7bab1f2223b6afd" and go\n' + TEXT.replace("story", "tale"), None, 3), (3, TEXT, "a", None), (None, None, None, None), (5, "", "a", 0), (1, TEXT, "a", 3)]
    docs = table(spark, rows)
    out = STAGES[name](docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert got
    for r in got:
        assert [r[n] for n in NAMES] == [f"x{k}" if k % 2 else k for k in range(len(NAMES))]
    assert STAGES[name](docs.limit(0)).collect() == []
