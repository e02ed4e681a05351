"""A link's score is worked out once for a pair of spans: not in the join, nor in a filter before the grouping."""

from graintable.operators import extract as X


def test_no_score_in_the_join(spark):
    texts = spark.createDataFrame([(1, "We took 5 g of salt. " + "x" * 100 + " and then that which 7 g")], "k int, t string")
    names = spark.createDataFrame([(1, "salt", "additive", 15, 19)], "k int, name string, category string, start int, stop int")
    found = X.scored_links(X.typed_spans(texts, "k", "t", {"mass": r"([0-9]+) (g)\b"}), names, texts, "k", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("RLIKE" in x for x in plan) == 1 and not [x for x in plan if "RLIKE" in x and ("Join" in x or "Filter" in x)]
    assert [(r.value, r.name, r.direction, r.distance) for r in found.collect()] == [(5.0, "salt", "value first", 4)]
