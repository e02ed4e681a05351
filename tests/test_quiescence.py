"""Groups that are complete after a pause, given out once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graintable.streaming import incremental as I
from graintable.streaming.quiescence import complete_groups, keyed_state

SCHEMA = "k string, ts timestamp"


def write(spark, path, rows):
    spark.createDataFrame([(k, t) for k, t in rows], "k string, s double").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, pause="90 seconds", delay="0 seconds"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with keyed_state(spark):
        I.run_available(complete_groups(stream, "ts", pause, "k", delay), path)
    found = spark.read.parquet(f"{path}/out")
    return sorted((r.k, r.a, r.b, r.n) for r in found.select("k", F.unix_seconds("start").alias("a"), F.unix_seconds("last").alias("b"), "n").collect())


def groups(rows, pause=90):
    out, newest = [], max(t for _, t in rows)
    for k in {k for k, _ in rows if k is not None}:
        times = sorted(t for x, t in rows if x == k)
        runs = [[times[0]]]
        for t in times[1:]:
            if t - runs[-1][-1] >= pause:
                runs.append([])
            runs[-1].append(t)
        out += [(k, r[0], r[-1], len(r)) for r in runs if r[-1] + pause <= newest]
    return sorted(out)


def test_each_group_comes_once_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((rng.choice(["a", "b", "c", None]), float(rng.randint(0, 3000))) for _ in range(150)), key=lambda r: r[1])
    for part in (rows[:60], rows[60:61], rows[61:]):
        write(spark, str(tmp_path), part)
        got = run(spark, str(tmp_path))
    assert got == groups(rows)
    assert run(spark, str(tmp_path)) == got  # nothing new: nothing comes again


def test_a_late_row_joins_two_open_groups(spark, tmp_path):
    first, late = [("a", 2000.0), ("a", 2100.0), ("b", 2120.0)], [("a", 2050.0)]
    for part in (first, late, [("b", 3000.0)]):
        write(spark, str(tmp_path), part)
        got = run(spark, str(tmp_path), "1 minute 30 seconds", "10 minutes")
    assert got == [("a", 2000, 2100, 3), ("b", 2120, 2120, 1)]


def test_a_pause_to_the_microsecond(spark, tmp_path):
    write(spark, str(tmp_path), [("a", 0.0), ("a", 90.0), ("a", 179.0), ("b", 1.0), ("b", 90.999999), ("d", 210.0), ("e", 210.000001), ("c", 300.0)])
    assert run(spark, str(tmp_path)) == [("a", 0, 0, 1), ("a", 90, 179, 2), ("b", 1, 90, 2), ("d", 210, 210, 1)]


def test_many_groups_of_a_key(spark, tmp_path):
    spark.range(20_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 100).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    begin = time.time()
    got = run(spark, str(tmp_path))
    assert got == [("a", 100 * i, 100 * i, 1) for i in range(19_999)]
    assert time.time() - begin < 60  # a timer for each group, with all groups read again, takes far longer


def test_by_arrival(spark, tmp_path):
    write(spark, str(tmp_path), [("a", 5.0), ("a", 6.0), ("b", 7.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    with keyed_state(spark):
        q = complete_groups(stream, "ts", "3 seconds", "k", clock="arrival").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] > 0 for p in q.recentProgress) < 1:
            time.sleep(0.5)
        while time.time() < until and len(spark.read.schema("k string, n long").parquet(f"{tmp_path}/out").collect()) < 2:
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        complete_groups(stream, "ts", "3 seconds", "k", clock="both")
