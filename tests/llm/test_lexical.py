"""Ranked lexical search against plain counting over all pairs, and its odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graintable.llm import lexical as L

DATA = "/root/testdata/sf0.01"


def terms(text):
    return [] if text is None else re.findall(L.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, k):
    """docs, items: (id, text). item -> [(score, id)] best first."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, text in set(items):
        if i is not None:
            wanted.setdefault(i, Counter()).update(terms(text))
    out = {}
    for i, bag in wanted.items():
        found = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // length if length else 0
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in bag.items() if t in b)
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        if found:
            out[i] = found[:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append((r[3], r[2]))
        assert r[1] == len(out[r[0]])
    return out


ODD = [(None, "Foo bar"), (1, None), (2, ""), (3, "foo-BAR_baz é́té foo"), (4, "foo" * 5), (5, "x\x00foo\x7fbar"), (6, "日本 foo 日本語 foo"), (7, "Foo bar"), (7, "Foo bar"), (8, "foo bar"), (9, " \t "), (10, "foo bar " * 30_000), (11, "É é foo")]
ITEMS = [(1, "foo"), (2, "FOO foo bar"), (2, "FOO foo bar"), (2, "baz"), (3, None), (4, ""), (5, "!!"), (6, "日本 É"), (None, "foo"), (7, "nothing here matches"), (8, "foo bar"), (9, "foo bar é́té")]


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_odd_rows_equal_plain_counting(spark, block_terms):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_doc", "_item", "score", "rank", "term", "n", "item_id")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("_term", "_times", "doc_id")})
    assert ranked(L.search(docs, items, 4, block_terms=block_terms)) == plain(ODD, ITEMS, 4)


@pytest.mark.parametrize("seed", range(2))
def test_ties_many_partitions_and_text_ids(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(L, "CELLS", 30)
    words = [chr(97 + i) for i in range(6)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in rng.sample(range(1000), 300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    found = L.search(df, spark.createDataFrame(items, "item_id int, text string"), 10)
    assert ranked(found) == plain(docs, items, 10)
    named = df.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    texts = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    assert ranked(L.search(named, texts, 3)) == {f"i{i}": [(s, f"d{d:03d}") for s, d in x] for i, x in plain(docs, items, 3).items()}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id in (1, 2, 9)"), items)):
        found = L.search(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_best_keeps_ties_and_sums_beyond_doubles():
    best = L.Best(2, 3)
    for ids in ([9, None, 4], [7, 1, 4], [2, 30, 31]):
        best.add(np.array([[5, 0], [5, 1], [5, 2]]), pa.array(ids, pa.int64()))
    assert [(s, i) for it, s, i in zip(best.item, best.score, best.id.to_pylist(), strict=True) if it == 0] == [(5, 1), (5, 2), (5, 4)]
    assert [(s, i) for it, s, i in zip(best.item, best.score, best.id.to_pylist(), strict=True) if it == 1] == [(2, 4), (2, 4), (2, 31)]
    block = L.load([(1, "a", 3), (1, "b", 1), (2, "b", 2)], pa.int64())
    big = np.array([2**59 + 1, 7])
    assert block.scores(np.array([0, 1]), big).tolist() == [3 * (2**59 + 1) + 7, 14]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = {}
    got = con.execute(L.SQL + " ORDER BY item_id, rank")
    for r in got.fetchall():
        want.setdefault(r[0], []).append((r[3], r[2]))
    assert want and ranked(L.op13_lexical_search(spark, DATA)) == want
