"""Keyed tables that grow by batches."""

import os

import pytest
from pyspark.sql import functions as F

from graintable.streaming import incremental as I
from graintable.streaming.keyed import KeyedTable


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def rows(table):
    return sorted(map(tuple, table.read().select("id", "key", "v").collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"{tmp_path}/t", "key", slots=8, buckets=4)


def frame(spark, data):
    return spark.createDataFrame(data, "key string, v int")


def test_batches_add_what_is_new(spark, table):
    assert table.read() is None
    assert table.merge(frame(spark, []), "v", "none") == 0 == table.merge(frame(spark, []), "v") and table.read() is None
    assert table.merge(frame(spark, [("b", 2), ("a", 1), ("a", 0), (None, 3), (None, 3)]), "v") == 4
    assert rows(table) == [(1, "a", 0), (2, "b", 2), (3, None, 3), (4, None, 3)]
    assert table.merge(frame(spark, [("c", 9), ("b", 1), ("d", 8), ("d", 7)]), "v") == 2
    assert rows(table)[4:] == [(5, "d", 7), (6, "c", 9)]
    assert table.merge(frame(spark, []), "v") == 0 and table.merge(frame(spark, [("a", 5), ("c", 1)]), "v") == 0
    table.compact()
    assert len(table.commits()) == 1 and len(rows(table)) == 6 and table.merge(frame(spark, [('z', 1)]), "v", "none") == 0
    assert table.merge(frame(spark, [("a", 5), ("e", 1)]), "v") == 1 and rows(table)[-1] == (7, "e", 1)


def test_a_label_is_merged_once_and_a_lost_commit_is_not_read(spark, table, monkeypatch):
    assert table.merge(frame(spark, [("a", 1), (None, 2)]), "v", "x:0") == 2
    assert table.merge(frame(spark, [("a", 1), (None, 2)]), "v", "x:0") == 0
    with monkeypatch.context() as m:
        m.setattr(table, "_log", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(frame(spark, [("b", 1)]), "v", "x:1")
    assert len(rows(table)) == 2
    assert table.merge(frame(spark, [("b", 1)]), "v", "x:1") == 1 and len(rows(table)) == 3
    assert table.merge(frame(spark, [("b", 1)]), "v", "x:2") == 0 == table.merge(frame(spark, [(None, 1)]), "v", "x:2")
    table.compact()
    assert table.merge(frame(spark, [(None, 1)]), "v", "x:1") == 0


def test_many_keys_equal_sets_and_bytes_follow_the_batch(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "key", slots=32, buckets=8)
    first, second = set(range(0, 60_000)), set(range(59_000, 59_500)) | set(range(80_000, 80_100))
    as_rows = lambda keys: spark.createDataFrame([(f"k{i}", i) for i in sorted(keys)], "key string, v int")
    t.merge(as_rows(first), "v")
    before = size(f"{tmp_path}/t")
    assert t.merge(as_rows(second), "v") == 100
    assert size(f"{tmp_path}/t") - before < before / 10
    got = t.read().agg(F.count("*"), F.count_distinct("key"), F.count_distinct("id"), F.max("id")).first()
    assert tuple(got) == (60_100, 60_100, 60_100, 60_100)
    absent = t._hashed(as_rows(range(100_000, 104_000)))
    names = [x["name"] for x in t.commits()]
    assert t.may_have(absent, names, list(range(8))).count() < 4_000 * 0.05
    there = t._hashed(as_rows(range(100, 2_100)))
    assert t.may_have(there, names, list(range(8))).count() == 2_000


def test_a_stream_goes_on_from_its_checkpoint(spark, table, tmp_path):
    for batch in ([("d", 1), ("b", 2)], [], [("d", 3), ("e", 4), ("c", 3)]):
        frame(spark, batch).write.mode("append").parquet(f"{tmp_path}/in")
        table.merge_stream(spark.readStream.schema("key string, v int").parquet(f"{tmp_path}/in"), "v", f"{tmp_path}/work")
    assert rows(table) == [(1, "d", 1), (2, "b", 2), (3, "c", 3), (4, "e", 4)]


def test_null_keys_of_a_merged_batch_stay_rows(spark):
    base = spark.createDataFrame([("a", 1)], "key string, id long")
    got = I.merge_batch(base, spark.createDataFrame([("a",), (None,), (None,), ("b",), ("b",)], "key string"), "key", "id", "key")
    assert sorted((r.id, r.key) for r in got.collect()) == [(1, "a"), (2, None), (3, None), (4, "b")]
