"""Dictionaries of substrings against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graintable.operators import dictionary as D

TERMS = ["a", "ab", "oak", "Oak Board", "oak board with a name that is longer than a window is wide " * 6, "é", "日本", "x\\Ey", "a.b", "board", "not there", "", None, "ak b", "end", "zz"]


@pytest.mark.parametrize("whole_word", [False, True])
@pytest.mark.parametrize("part_rows", [1_000_000, 3])
def test_equals_plain_search(spark, whole_word, part_rows, monkeypatch):
    monkeypatch.setattr(D, "WINDOW", 16)
    monkeypatch.setattr(D, "BLOCK", 2_000)
    rng = random.Random(1)
    bits = ["oak", " ", "board", "Ab", "é", "日本", "_", "x\\Ey", "a.b", "-", "\n", "q", "end", "zz ", TERMS[4]]
    texts = ["", None, "end", "OAK", "oaken oak", "zzz"] + ["".join(rng.choice(bits) for _ in range(rng.choice([3, 20, 300]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, r.term) for r in D.dictionary_hits(df, "k", "t", spark.createDataFrame([(t,) for t in TERMS], "term string"), whole_word, part_rows).collect()}
    want = set()
    for k, t in enumerate(texts):
        for term in {x.lower() for x in TERMS if x}:
            low = (t or "").lower()
            if (re.search(rf"(?<!\w){re.escape(term)}(?!\w)", low) if whole_word else term in low):
                want.add((k, term))
    assert got == want


def test_a_hundred_thousand_terms(spark):
    """The plan holds no term; few are looked for in a text."""
    terms = spark.range(100_000).select(F.concat(F.lit("t"), F.lpad(F.hex(F.xxhash64("id")), 16, "0"), F.lit("z")).alias("term"))
    some = [r.term for r in terms.orderBy("term").limit(5).collect()]
    df = spark.createDataFrame([(1, f"one {some[0]} two {some[3].upper()}!"), (2, "none"), (3, some[1][1:])], "k int, t string")
    found = D.dictionary_hits(df, "k", "t", terms)
    assert sorted((r.k, r.term) for r in found.collect()) == [(1, some[0].lower()), (1, some[3].lower())]
    assert len(found._jdf.queryExecution().toString()) < 200_000


def test_labels_by_priority(spark):
    df = spark.createDataFrame([(1, "oak and pine", None), (2, "pine", "kept"), (3, "fir", None), (4, None, None)], "k int, t string, v string")
    terms = spark.createDataFrame([("oak", "hard", 2), ("pine", "soft", 1), ("Oak", "tree", 3)], "term string, label string, priority int")
    assert {r.k: r.v for r in D.first_label(df, "k", "t", terms, "v").collect()} == {1: "soft", 2: "kept", 3: None, 4: None}
    assert {r.k: r.tags for r in D.all_labels(df, "k", "t", terms).collect()} == {1: ["hard", "soft", "tree"], 2: ["soft"], 3: [], 4: []}
    assert D.all_labels(df, "k", "t", terms.limit(0)).where(F.size("tags") > 0).count() == 0
