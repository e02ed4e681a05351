"""Dedup by two keys against the loop it stands for, and by titles of all scripts."""

import random

import pytest
from pyspark.sql import functions as F

from graintable.operators import aggregates as A
from graintable.operators import relational as R
from graintable.operators.dedup import dedup_two_keys
from graintable.operators.quantiles import quantiles


def loop(rows):
    """rows (at, a, b, junk) in arrival order -> the `at` of those that stay."""
    first, second, out = set(), set(), []
    for at, a, b, junk in sorted(rows):
        if not a or a in first or (b and b in second) or junk:
            continue
        first.add(a)
        if b:
            second.add(b)
        out.append(at)
    return out


@pytest.mark.parametrize(("seed", "small"), [(0, 0), (1, 0), (2, 40), (3, 200_000)])
def test_equals_the_loop(spark, seed, small):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, *[f"a{j}" for j in range(40)]]), rng.choice(["", None, *[f"b{j}" for j in range(30)]]), rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "at int, a string, b string, junk boolean").withColumns({"_k1": F.lit(1), "_o": F.lit(2)})
    got = dedup_two_keys(df, "a", "b", ["at"], F.col("junk"), small=small)
    assert got.columns == df.columns
    assert sorted(r.at for r in got.collect()) == loop(rows)


def test_a_chain_and_an_id_that_comes_back(spark):
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}", False) for i in range(41)]  # each row shares a key with the one before
    assert sorted(r.at for r in dedup_two_keys(spark.createDataFrame(chain, "at int, a string, b string, junk boolean"), "a", "b", ["at"], small=0).collect()) == loop(chain) == list(range(0, 41, 2))
    back = [(0, "x", "1", False), (1, "y", "1", False), (2, "y", "2", False)]  # y is rejected for its second key and stays with another
    assert sorted(r.at for r in dedup_two_keys(spark.createDataFrame(back, "at int, a string, b string, junk boolean"), "a", "b", ["at"]).collect()) == [0, 2]


def test_equal_rows_and_empty_tables(spark):
    rows = [(None, "a", "t"), (None, "a", "t"), (None, "b", "t"), (3, "c", None), (3, "c", None)]
    df = spark.createDataFrame(rows, "at int, a string, b string")
    for small in (0, 9):
        assert sorted((r.a, r.b) for r in dedup_two_keys(df, "a", "b", ["at"], small=small).collect()) == [("a", "t"), ("c", None)]
        assert dedup_two_keys(df.limit(0), "a", "b", ["at"], small=small).collect() == []


def test_titles_of_all_scripts(spark):
    rows = [(1, "氧化铈 纳米"), (2, "氧化铈—纳米!"), (3, "Оксид церия"), (4, "оксид церия."), (5, None), (6, None), (7, ""), (8, "?!"), (9, "Ceria 2"), (10, "CERIA-2"), (11, "氧化铝")]
    got = R.dedup_by_title(spark.createDataFrame(rows, "k int, t string"), "t", [F.col("k")])
    assert sorted(r.k for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9, 11]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", float("nan")), ("a", None)], "g string, x double")
    assert quantiles(df, "x", [0.5, 1.0]).first().q == [1.5, 2.0]
    assert {r.g: r.q for r in quantiles(df, "x", [0.5], ["g"]).collect()} == {"a": [1.5]}
    row = A.describe_numeric(df, ["x"]).first()
    assert (row.n, row["mean"], row.median, row.q3, row.least, row.greatest) == (2, 1.5, 1.5, 1.75, 1.0, 2.0)
    assert quantiles(df.select(F.col("x").cast("float")), "x", [0.0, 1.0]).first().q == [1.0, 2.0]


def test_recover_rules_run_before_the_aggregation(spark):
    base = spark.createDataFrame([(1, "other"), (2, "other"), (3, "other")], "k int, v string")
    texts = spark.createDataFrame([(1, "head x"), (1, "zz body"), (2, "body"), (2, None)], "k int, text string")
    none = spark.createDataFrame([], "k int, value string")
    found = R.recover(base, "k", "v", none, texts, none.withColumnRenamed("value", "tag"), F.when(F.col("text").startswith("head"), "head"), F.when(F.contains("text", F.lit("body")), "body"))
    assert sorted(map(tuple, found.collect())) == [(1, "head"), (2, "body"), (3, "unidentified")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max(text" not in plan
