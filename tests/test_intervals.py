"""Joins of intervals against brute force, draws by place, spans of long texts."""

import random
import re

from pyspark.sql import functions as F

from graintable.operators import extract as X
from graintable.operators import modelling as M
from graintable.operators.intervals import overlaps


def test_overlaps_of_uneven_lengths(spark):
    rng = random.Random(1)
    a = [(i, rng.randint(0, 2), s := rng.randint(-50, 3000), s + rng.choice([0, 1, 3, 9, 40, 900])) for i in range(200)] + [(999, 1, 0, 10**12), (998, None, 0, 9), (997, 1, None, 9)]
    b = [(i, rng.randint(0, 2), s := rng.randint(-50, 3000), s + rng.choice([-1, 0, 2, 5, 17, 300, 5000])) for i in range(200)]
    left, right = spark.createDataFrame(a, "i int, k int, s long, e long"), spark.createDataFrame(b, "j int, k int, s long, e long").withColumns({"_bin": F.lit(1), "a": F.lit(2)})
    for on in (["k"], []):
        want = sorted((x[0], y[0]) for x in a for y in b if (not on or x[1] == y[1]) and x[2] is not None and x[2] <= y[3] and y[2] <= x[3] and y[2] <= y[3])
        assert sorted((r.a.i, r.b.j) for r in overlaps(left, right, on, ("s", "e"), ("s", "e")).collect()) == want
        assert overlaps(left.limit(0), right, on, ("s", "e"), ("s", "e")).collect() == []


def test_one_long_span_widens_no_other(spark):
    """A span of 100,000 characters among short ones: few rows meet, and the links are those of all pairs."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["5 g", "salt", "of", "and", "then.", "(x)"]) for _ in range(30_000))
    quantities = [(1, "mass", m.start(), m.end()) for m in re.finditer(r"\b5 g\b", text)][::9]
    names = [(1, "salt", "c", m.start(), m.end()) for m in re.finditer(r"\bsalt\b", text)][::5] + [(1, "all", "c", 10, min(100_010, len(text)))]
    texts = spark.createDataFrame([(1, text)], "k int, t string")
    got = X.scored_links(spark.createDataFrame(quantities, "k int, type string, start int, stop int"), spark.createDataFrame(names, "k int, name string, category string, start int, stop int"), texts, "k", "t")
    want = {}
    for _, _, s, e in quantities:
        for _, n, c, a, b in names:
            before, behind = a - e, s - b
            distance = max(before, behind, 0)
            if distance > X.LINK_DISTANCE:
                continue
            between, whole = text[min(e, b):max(s, a)].lower(), text[min(s, a):max(e, b)]
            score = 1.0 - distance / X.LINK_DISTANCE * X.LINK_FAR + (X.LINK_VALUE_FIRST if before >= 0 else X.LINK_NAME_FIRST if behind >= 0 else 0)
            score += sum(v for p, v in ((X.LINK_STOPS, X.LINK_STOP), (X.LINK_JOINS, X.LINK_JOIN), (X.LINK_OFS, X.LINK_OF)) if re.search(p, between)) + (X.LINK_BRACKETS if "(" in whole and ")" in whole else 0)
            if round(score, 4) >= X.LINK_LEAST:
                key = (-round(score, 4), abs(a - e), a, n)
                want[s] = min(want.get(s, (key, (n, distance))), (key, (n, distance)))
    assert {r.start: (r.name, r.distance) for r in got.collect()} == {s: x[1] for s, x in want.items()}


def test_running_sums_and_long_texts(spark):
    rng = random.Random(3)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 16, 17, 1000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    for r in df.select("x", X.running_sums(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[:i + 1]) for i in range(len(r.x))]
    text = "ab 1 g, " * 60_000
    got = X.typed_spans(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", {"mass": r"([0-9]) (g)", "g": "()(g)"}).agg(F.count("*"), F.max("stop"), F.count_if(F.col("type") == "g")).first()
    assert tuple(got) == (60_000, len(text) - 2, 0)


def test_typed_spans_equal_all_pairs(spark):
    rng = random.Random(4)
    kinds = {"a": "(x)(yz?)", "b": "(y)(zx)", "c": "(z)(x*y)"}
    texts = ["".join(rng.choice("xyz ") for _ in range(60)) for _ in range(40)]
    got = X.typed_spans(spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "k int, t string"), "k", "t", kinds)
    want = []
    for i, t in enumerate(texts):
        found = [(r, k, m.start(), m.end(), m[0]) for r, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t)]
        want += [(i % 30, k, s, e, raw) for r, k, s, e, raw in found if not any(q < r and a < e and s < b for q, _, a, b, _ in found)]
    assert sorted((r.k, r.type, r.start, r.stop, r.raw) for r in got.collect()) == sorted(want)


def test_draws_by_place(spark):
    values = spark.createDataFrame([("a", "hot")] * 50 + [("a", "x"), ("a", "y"), ("b", "z"), (None, "n"), ("c", None)], "g string, v string")
    asked = [(i, g, (i + 0.5) / 104) for g in ("a", "b", "c", None) for i in range(104)]
    draws = spark.createDataFrame(asked, "i int, g string, u double").withColumn("v", F.lit("old"))
    got = {}
    for r in M.draw_values(draws, values, "v", ["g"], weighted=True).collect():
        got.setdefault(r.g, []).append(r.v)
    assert {g: sorted(set(map(str, x))) for g, x in got.items()} == {"a": ["hot", "x", "y"], "b": ["z"], "c": ["None"], None: ["None"]}
    assert [got["a"].count(v) for v in ("hot", "x", "y")] == [100, 2, 2] and all(len(x) == 104 for x in got.values())
    even = [r.v for r in M.draw_values(draws.where("g = 'a'").drop("g"), values.where("g = 'a'").drop("g"), "v", top=2, extra="unknown").collect()]
    assert sorted((v, even.count(v)) for v in set(even)) == [("hot", 35), ("unknown", 34), ("x", 35)]


def test_a_value_that_occurs_ten_billion_times(spark, monkeypatch):
    """Places are counted, never listed."""
    rows = spark.createDataFrame([("hot", 10**10), ("rare", 10**7)], "_value string, _n long")
    numbered = rows.withColumns({"_before": F.when(F.col("_value") == "hot", 0).otherwise(10**10).cast("long"), "_total": F.lit(10**10 + 10**7)})
    monkeypatch.setattr(M, "numbered_values", lambda *_: numbered)
    draws = spark.range(2000).select("id", ((F.col("id") + 0.5) / 2000).alias("u"))
    got = {r.v: r["n"] for r in M.draw_values(draws, rows.select(F.col("_value").alias("v")), "v", weighted=True).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 1998, "rare": 2}


def test_pools_ranges_and_choices(spark):
    rng = random.Random(6)
    rows = [(m, f"s{min(rng.randint(0, 30), rng.randint(0, 30))}", float(rng.randint(0, 100))) for m in ("hot", "cold", "none") for _ in range(200)]
    df = spark.createDataFrame(rows, "method string, solvent string, temp double")
    top = {m: {v for v, _ in sorted(((v, sum(1 for r in rows if r[:2] == (m, v))) for v in {r[1] for r in rows if r[0] == m}), key=lambda x: (-x[1], x[0]))[:5]} for m in ("hot", "cold", "none")}
    ranges = {"temp": ("method", {"hot": (100, 250), "cold": (0, 20)}, (60, 220))}
    made = M.candidate_pools(df, "method", df.union(df.limit(1).select(F.lit("new"), "solvent", "temp")), 300, 300, ["temp"], ["solvent"], 5, F.col("temp"), pools={"solvent": 5}, ranges=ranges, choices={"hours": [1, 2, 4]})
    found = made.collect()
    assert len(found) == 1200 and {r.hours for r in found} == {1, 2, 4}
    for m, (low, high) in {"hot": (100, 250), "cold": (0, 20), "none": (60, 220)}.items():
        own = [r for r in found if r.method == m]
        assert len(own) == 300 and all(low <= r.temp <= high for r in own) and {r.solvent for r in own} == top[m]
    assert {r.solvent for r in found if r.method == "new"} == {r.solvent for r in found if r.method == "new"} and len([r for r in found if r.method == "new"]) == 300
    again = M.candidate_pools(df, "method", df, 300, 7, ["temp"], ["solvent"], 5, F.col("temp"), pools={"solvent": 5}, ranges=ranges, choices={"hours": [1, 2, 4]}).collect()
    best = sorted((r for r in found if r.method == "hot"), key=lambda r: (-r.score, r.candidate))[:7]
    assert sorted(r.candidate for r in again if r.method == "hot") == sorted(r.candidate for r in best)
