"""What line dedup moves of its texts."""

from pyspark.sql import functions as F

from graintable.llm.line_dedup import lines_of_leaves


def records_shuffled(spark, since):
    """Rows written to shuffles by executions from `since` on."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        run = runs.apply(i)
        if run.executionId() >= since:
            values = store.executionMetrics(run.executionId())
            for j in range(run.metrics().size()):
                m = run.metrics().apply(j)
                if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_lines_of_other_leaves_stay_where_they_are(spark):
    lines = spark.range(20_000).select(F.xxhash64("id").alias("leaf"), F.col("id").cast("string").alias("masked"))
    lines = lines.unionByName(spark.range(3).select(F.xxhash64(F.lit(5).cast("long")).alias("leaf"), F.lit("copy").alias("masked")))
    leaves = spark.createDataFrame([(i,) for i in (5, 77, 30_000)], "id long").select(F.xxhash64("id").alias("leaf"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = max([runs.apply(i).executionId() for i in range(runs.size())], default=-1) + 1
        assert sorted(r.masked for r in lines_of_leaves(lines, leaves).collect()) == ["5", "77", "copy", "copy", "copy"]
        assert 0 < records_shuffled(spark, since) < 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
