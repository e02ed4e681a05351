"""What a query moves and how often it reads, as its plan or its source tells."""

from pyspark.sql import functions as F

from graintable.operators import aggregates as A
from graintable.operators import modelling as M
from graintable.plans.extraction import rebuilt


def test_texts_are_dealt_once_before_their_words(spark):
    texts = spark.createDataFrame([(1, "B a  b"), (2, ""), (3, None), (4, "x\ny X")], "doc_id long, text string")
    found = rebuilt(texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange ") == 1
    got = {r.doc_id: r.rebuilt for r in found.collect()}
    want = {r.k: r.h for r in spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "x y x")], "k long, t string").select("k", F.md5("t").alias("h")).collect()}
    assert {k: v for k, v in got.items() if k != 3} == {k: v for k, v in want.items() if k != 3}


def test_tuning_reads_its_samples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x: float) -> float:
        seen.add(1)
        return x

    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") + 1.0).alias("y"))
    rows = rows.withColumn("a", F.udf(count, "double")("a"))
    assert M.tune(rows, "y", ["a"], "id", {"regParam": [0.0, 0.1]}).count() == 2
    assert seen.value == 60


def test_few_groups_of_a_box_do_not_gather(spark, tmp_path):
    spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("y")).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        found = A.box_stats(spark.read.parquet(f"{tmp_path}/t"), "g", "y")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.g, r.median, r.low, r.high, r.outliers) for r in found.collect()) == [(0, 9999.0, 0.0, 19998.0, 0), (1, 10000.0, 1.0, 19999.0, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
