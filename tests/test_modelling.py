"""Bounds of the modelling jobs and equality of streams and batches."""

from pyspark.sql import functions as F

from graintable.operators import modelling as M
from graintable.plans import registry
from graintable.streaming import incremental as I

DATA = "/root/testdata/sf0.001"
Q = registry.queries()


def test_folds_are_disjoint(spark):
    df = M.assign_group_folds(spark.range(500).withColumn("k", F.col("id") % 50), "k", 5)
    assert df.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def synthetic(spark):
    """y follows x; z is noise."""
    return spark.range(600).select("id", (F.col("id") % 40).alias("x"), F.pmod(F.xxhash64("id"), F.lit(17)).alias("z")).withColumn("y", F.exp(F.col("x") / 10.0) + 1)


def test_regressor_learns_and_importance_finds_the_driver(spark):
    data = synthetic(spark)
    model = M.fit_regressor(data, "y", ["x", "z"], rounds=5)
    assert M.regression_metrics(M.predict(model, data, ["x", "z"]), "y", "p").first()["log_r2"] > 0.9
    rows = {r.column: r.importance for r in M.permutation_importance(model, data, "y", ["x", "z"], [], ["x", "z"], 1).collect()}
    assert rows["x"] > 0.5 > abs(rows["z"])


def test_ladder_and_search(spark):
    data = synthetic(spark).withColumn("g", (F.col("x") % 4).cast("string"))
    rows = {r.model: r.mae for r in M.ablation(data, "y", "g", ["x", "z"], "id").collect()}
    assert rows["boosted trees"] < rows["global mean"] and rows["ridge"] < rows["group mean"]
    points = {r.point: r.rmse for r in M.tune(data, "y", ["x", "z"], "id", {"regParam": [0.0, 10.0]}).collect()}
    assert points["regParam=0.0"] < points["regParam=10.0"]


def test_registered_model_queries_give_rows(spark):
    for name in ("ml5_fit_classifier", "ml9_interval_score", "ml10_fit_per_group", "st4_sample_keys"):
        assert Q[name](spark, DATA).count() > 0


def test_candidates_stay_in_range(spark):
    df = Q["ml7_generate_candidates"](spark, DATA)
    assert df.count() == 5000
    assert df.where("quantity is null or p_type is null").count() == 0


def test_per_group_fit_equals_least_squares(spark):
    import numpy as np

    df = spark.createDataFrame([("a", i % 7, float(i % 13), float(3 + 2 * (i % 13))) for i in range(200)], "g string, k long, x double, y double")
    w = M.fit_per_group(df, "g", "k", ["x"], "y", 80, 3, ridge=1e-9).first()["weights"]
    assert np.allclose(w, [3, 2], atol=1e-4)


def test_interval_score_prefers_the_target(spark):
    df = spark.createDataFrame([(1, 90.0, 100.0, 110.0), (2, 300.0, 400.0, 500.0)], "id long, lo double, mid double, hi double")
    rows = {r.id: r.interval_score for r in M.interval_score(df, "lo", "mid", "hi", 100.0).collect()}
    assert rows[1] > 2 > rows[2]


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.unionByName(events)
    path, stream = I.staged(spark, twice, "test")
    streamed = I.run_available(I.incremental(stream, "ts", "event_id", "60 days"), path)
    assert streamed.select("event_id").exceptAll(I.incremental(twice, "ts", "event_id").select("event_id")).count() == 0
    assert streamed.count() == events.count()


def test_content_dedup_is_idempotent(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    once = I.dedup_content(docs, "text", 300, "doc_id")
    assert I.dedup_content(once, "text", 300, "doc_id").count() == once.count()


def test_halving_keeps_the_better_half(spark):
    """The winner's error on keys that no rung saw is below the grid's median there."""
    import statistics

    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("x"), ((F.col("id") * 7) % 31).cast("double").alias("z"))
    rows = rows.withColumn("y", F.exp(F.sin(F.col("x") / 9) + F.when(F.col("z") > 15, 1.0).otherwise(0.0)))
    split = M.group_holdout(rows, "k", 30)
    train, test = split.where("not held_out").drop("held_out"), split.where("held_out").drop("held_out")
    grid = [{"rounds": 1, "depth": 1}, {"rounds": 3, "depth": 2}, {"rounds": 2, "depth": 1}, {"rounds": 8, "depth": 4}]
    table = M.halving(train, "y", ["x", "z"], [], "k", grid, 2, (30, 60, 100)).collect()
    assert [(sum(r.rung == i for r in table), sum(r.kept for r in table if r.rung == i)) for i in (1, 2, 3)] == [(4, 2), (2, 1), (1, 1)]
    counts = [max(r.rows for r in table if r.rung == i) for i in (1, 2, 3)]
    assert counts == sorted(counts) and counts[2] == train.count()
    for i in (1, 2):
        rung = sorted((r.score, r.kept) for r in table if r.rung == i)
        assert all(kept == (at < len(rung) / 2) for at, (_, kept) in enumerate(rung))

    def error(point):
        model = M.fit_regressor(train, "y", ["x", "z"], [], **point)
        return M.predict(model, test, ["x", "z"], []).agg(F.avg(F.abs(F.log("p") - F.log("y")))).first()[0]

    winner = next(r.point for r in table if r.rung == 3 and r.kept)
    errors = {", ".join(f"{c}={p[c]}" for c in sorted(p)): error(p) for p in grid}
    assert errors[winner] <= statistics.median(errors.values())
