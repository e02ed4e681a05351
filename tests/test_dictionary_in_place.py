"""Labels of a dictionary's terms, found beside their texts."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graintable.operators import dictionary as D

WORDS = ["oak", "Oak", "oa", "ak b", "k", "é", "日本", "本", "a.b", "board", "boards and more of them", "boards and more", "x", "long" * 9, "long" * 8 + "x", "zz\0", "\0"]
LABELS = ["p", "q", None, "r", "s"]


def given(rng):
    texts = ["", None, "oak", "OAKEN board", "日本", "日本本", "\0", "oak\0", "zz", "zz\0"] + ["".join(rng.choice([*WORDS, " ", " ", "-", "_", "İ", "Ⅷ", "一"]) for _ in range(rng.choice([2, 9, 80]))) for _ in range(60)]
    docs = [(rng.choice([None, *range(45)]), t, rng.choice([None, None, "kept"]), i) for i, t in enumerate(texts)]
    terms = [(w, rng.choice(LABELS), rng.choice([1, 2, 3, None])) for w in [*WORDS, *WORDS, "", None]]
    return docs, terms


def stands(term, text, whole_word):
    return bool(re.search(rf"(?<!\w){re.escape(term)}(?!\w)", text)) if whole_word else term in text


@pytest.mark.parametrize("whole_word", [False, True])
@pytest.mark.parametrize("part_rows", [1_000_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_labels_of_repeated_and_null_ids(spark, whole_word, part_rows, seed, monkeypatch):
    """An id stands for all its rows' texts, null is no id."""
    monkeypatch.setattr(D, "WINDOW", 7)
    monkeypatch.setattr(D, "BLOCK", 5)
    docs, terms = given(random.Random(seed))
    df = spark.createDataFrame(docs, "k int, t string, v string, i int").repartition(3)
    known = spark.createDataFrame(terms, "term string, label string, priority int")
    spark_lower = {r.i: r.t for r in df.select("i", F.lower("t").alias("t")).collect()}
    low = [(w.lower(), label, p) for w, label, p in terms if w]
    hit = lambda i, w: spark_lower[i] is not None and stands(w, spark_lower[i], whole_word)
    same = lambda k, wanted: [d[3] for d in docs if k is not None and d[0] == k and wanted(d)]

    got = {r.i: r.tags for r in D.all_labels(df, "k", "t", known, whole_word=whole_word, part_rows=part_rows).collect()}
    assert got == {i: sorted({label for w, label, _ in low if label is not None and any(hit(j, w) for j in same(k, lambda d: True))}) for k, _, _, i in docs}

    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    want = {}
    for k, _, v, i in docs:
        found = [(p, label) for w, label, p in low if any(hit(j, w) for j in same(k, lambda d: d[2] is None))]
        want[i] = v if v is not None else min(found, key=order)[1] if found else None
    filled = D.first_label(df, "k", "t", known, "v", whole_word=whole_word, part_rows=part_rows)
    assert filled.columns == df.columns
    assert {r.i: r.v for r in filled.collect()} == want


def test_single_ids_move_no_rows(spark):
    """Where ids are single, a text's labels are found beside it: nothing is exploded or shuffled."""
    df = spark.createDataFrame([(i, f"oak {i}", None) for i in range(20)], "k int, t string, v string")
    terms = spark.createDataFrame([("oak", "wood", 1), ("3", "three", 0)], "term string, label string, priority int")
    for found in (D.all_labels(df, "k", "t", terms), D.first_label(df, "k", "t", terms, "v", whole_word=True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan, plan
    assert [r.v for r in D.first_label(df, "k", "t", terms, "v", whole_word=True).orderBy("k").collect()][2:5] == ["wood", "three", "wood"]


@pytest.mark.parametrize("whole_word", [False, True])
def test_work_at_size(spark, whole_word):
    """Nine million characters in one task, 3,000 terms: a join of windows to pieces took 60 s, and 176 s for whole words."""
    rng = random.Random(1)
    bits = ["th", "er", "in", "an", "ou", "st", "ion", "ed", "le", "wh", "ea", "ñ"]
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 4])))
    terms = spark.createDataFrame([(w, w, -len(w)) for w in dict.fromkeys(word() for _ in range(6_000))][:3_000], "term string, label string, priority int").coalesce(1)
    text = " ".join(word() for _ in range(15_000))
    df = spark.range(0, 90, 1, 1).select("id", F.concat(F.lit(text), F.col("id").cast("string")).alias("t"), F.lit(None).cast("string").alias("v"))
    start = time.time()
    found = D.first_label(df, "id", "t", terms, "v", whole_word=True).where("v is not null") if whole_word else D.all_labels(df, "id", "t", terms).where(F.size("tags") > 0)
    assert found.count() == 90
    assert time.time() - start < 15


def test_odd_arrays():
    """Sliced, empty and null texts."""
    trie = D.Trie(pa.array(["ab", "b", "abcdefghi", "abcdefghijabcdefghij"]))
    for texts in (pa.array(["x", "ab", None, "", "cab"])[1:], pa.array(["ab", None, "", "cab"], pa.large_string())):
        row, term = trie.hits(texts, False)
        assert list(zip(row.tolist(), term.tolist(), strict=True)) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    for texts in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        assert not len(trie.hits(texts, True)[0])
    row, term = trie.hits(pa.array(["abcdefgh", "i", "abcdefghij abcdefghijabcdefghij", "abcdefghijabcdefghi", "j"]), True)
    assert list(zip(row.tolist(), term.tolist(), strict=True)) == [(2, 3)]
