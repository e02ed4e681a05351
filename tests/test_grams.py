"""Runs of characters of a text."""

import time

from pyspark.sql import functions as F

from graintable.operators.dictionary import grams


def test_grams_of_odd_texts(spark):
    texts = ["", None, "ab", "abcab", "a\nb\r", "é漢😀x", "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", grams(F.col("t"), 2).alias("g"))
    for r in df.collect():
        assert (r.g or []) == list(dict.fromkeys(r.t[i:i + 2] for i in range(len(r.t) - 1))) if r.t is not None else not r.g


def test_a_long_text_costs_one_pass(spark):
    """A run's place isn't looked for from the start of the text."""
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")), " ").alias("t"))
    start = time.time()
    assert long.select(F.size(grams(F.col("t"), 4)).alias("n")).first()["n"] > 10_000
    assert time.time() - start < 12
