"""Literal cases of the column builders and text operators, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.operators import extract as X
from graintable.operators import relational as R
from graintable.operators import reshape


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [("about 5", 5.0), ("<5", 5.0), (".5", 0.5), ("5-9", 7.0), ("1.25–1.5", 1.38), ("5 miles", 5.0), ("unknown", None), ("", None), (None, None), ("~ 18 weeks", 18.0)])
def test_parse_measure(spark, text, want):
    assert one(spark, C.parse_measure(F.col("t")), t=("string", text)) == want


@pytest.mark.parametrize("text, want", [("5", 5.0), (" 5.5 ", 5.5), ("5d", None), ("nan", None), ("inf", None), ("1e3", 1000.0), (None, None)])
def test_to_number(spark, text, want):
    assert one(spark, C.to_number(F.col("t")), t=("string", text)) == want


def test_canonical_scalar(spark):
    for text, want in (("3.0", "3"), ("3.14159", "3.1416"), (" a ", "a"), (None, None)):
        assert one(spark, C.canonical_scalar(F.col("t")), t=("string", text)) == want


def test_tokens_do_not_cross(spark):
    """A pattern's halves in two tokens are no hit."""
    rules = [("red wool", ("red.*wool",)), ("any cotton", ("cotton",))]
    assert one(spark, C.classify_tokens(F.lower("t"), rules), t=("string", "Red silk; green wool; white cotton")) == "any cotton"
    assert one(spark, C.classify_tokens(F.lower("t"), rules), t=("string", "red lamb wool; cotton")) == "red wool"
    assert one(spark, C.classify_tokens(F.lower("t"), rules), t=("string", None)) is None


def test_symbol_case_and_word_boundary(spark):
    c = C.fill_by_pattern(F.lit(None).cast("string"), F.col("t"), [("indium", (r"\bIn(?i:-plated)",))])
    assert one(spark, c, t=("string", "an In-Plated wire")) == "indium"
    assert one(spark, c, t=("string", "wires kept in-plated boxes")) is None
    assert one(spark, C.topic_mask([F.col("t")], ["harm"]), t=("string", "A pharmacy of charms")) is False
    assert one(spark, C.topic_mask([F.col("t")], ["harm"]), t=("string", "Harm to fish")) is True


def test_staged_values(spark):
    df = spark.createDataFrame([(1, "Loaves were proofed at 30 C for one hour and then baked at 220 C until brown."), (2, "Rolls were baked at 190 C."), (3, None)], "id long, t string")
    rows = {r.id: (r.proofed, r.baked) for r in X.extract_staged(df, "id", "t", [("proofed", "proofed"), ("baked", "baked")], r"([0-9]+) C").collect()}
    assert rows == {1: (30.0, 220.0), 2: (None, 190.0)}


def test_context_look_back(spark):
    df = spark.createDataFrame([(1, "We used the long ruler. It had been cleaned. Every board measured 44 cm."), (2, "By guess and with the long ruler, one board measured 51 cm.")], "id long, t string")
    found = X.extract_in_context(df, "id", "t", r"([0-9.]+) cm", [("ruler", "ruler"), ("tape", "tape")], "guess").collect()
    assert [(r.id, r.kind, r.value) for r in found] == [(1, "ruler", 44.0)]


def test_patch(spark):
    df = spark.createDataFrame([(1, "old"), (2, "b"), (3, "c")], "k long, v string")
    patch = spark.createDataFrame([(1, "new"), (2, None), (3, "c"), (9, "z")], "k long, v string")
    assert sorted((r.k, r.v, r.changed_) for r in R.apply_patch(df, patch, "k", ["v"]).collect()) == [(1, "new", True), (2, "b", False), (3, "c", False)]
    again = R.apply_patch(R.apply_patch(df, patch, "k", ["v"]).drop("changed_"), patch, "k", ["v"])
    assert again.where("changed_").count() == 0


def test_null_keys_match_nothing(spark):
    child = spark.createDataFrame([(None, None), ("a", None)], "k string, v string")
    parent = spark.createDataFrame([(None, "x", 1), ("a", "y", 1), ("a", "z", 2)], "k string, v string, o int")
    assert sorted(((r.k, r.v) for r in R.fill_from(child, parent, "k", ["v"], "o").collect()), key=str) == [("a", "z"), (None, None)]


def test_nearest_link_is_brute_force(spark):
    import random

    rng = random.Random(3)
    left = [(d, rng.randrange(200)) for d in range(5) for _ in range(20)]
    right = [(d, rng.randrange(200), f"t{rng.randrange(9)}") for d in range(5) for _ in range(20)]
    got = X.nearest_link(spark.createDataFrame(list(set(left)), "d long, p long"), spark.createDataFrame(right, "d long, q long, t string"), "d", "p", "q", "t", 7)
    want = set()
    for d, p in set(left):
        near = [(abs(p - q), q, t) for e, q, t in right if e == d and abs(p - q) <= 7]
        if near:
            want.add((d, p, min(near)[2], min(near)[0]))
    assert {(r.d, r.p, r.t, r.distance) for r in got.collect()} == want


def test_ensure_columns_and_validate(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert reshape.ensure_columns(df, "id long, b string, c double", {"a": "id"}).collect()[0].asDict() == {"id": 1, "b": "x", "c": None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v string")
    assert R.apply_patch(empty, empty, "k", ["v"]).count() == 0
    assert R.assign_ids(empty, empty, "k", "k").count() == 0
    assert X.sentences(empty, "k", "v").count() == 0
