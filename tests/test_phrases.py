"""Terms of several words: the texts' own runs stay where they are."""

import pytest

from graintable.operators import extract as X

TEXTS = [(1, "All rights reserved. The public license, a License of public use"), (2, None), (3, ""), (4, "rights; all rights"), (5, "token token")]
TERMS = [("public license", "legal"), ("license", "permit"), ("all rights reserved", "claim"), ("rights", "claim"), ("token", "secret"), ("token", "later"), ("a b c d e", "long"), ("", "none")]
WANT = [(1, 1, 3, "claim"), (1, 5, 2, "legal"), (1, 8, 1, "permit"), (4, 1, 1, "claim"), (4, 3, 1, "claim"), (5, 1, 1, "later"), (5, 2, 1, "later")]


@pytest.mark.parametrize("part_rows", [1, 2, 500_000])
def test_terms_in_parts(spark, part_rows):
    found = X.phrase_spans(spark.createDataFrame(TEXTS, "k int, t string"), "k", "t", spark.createDataFrame(TERMS, "term string, name string"), part_rows=part_rows)
    assert sorted(tuple(r) for r in found.collect()) == WANT


def test_runs_are_neither_broadcast_nor_shuffled(spark, tmp_path):
    spark.createDataFrame(TEXTS, "k int, t string").write.parquet(f"{tmp_path}/t")
    terms = spark.range(500).selectExpr("'t' || id as term", "cast(id as string) as name")
    found = X.phrase_spans(spark.read.parquet(f"{tmp_path}/t"), "k", "t", terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning(phrase" not in plan
