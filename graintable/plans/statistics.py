"""Queries of the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.operators import aggregates as A
from graintable.plans.base import query, table
from graintable.plans.relational import PO, part_orders

_COLS = ["l_quantity", "l_discount", "l_tax", "o_totalprice"]


def lines(spark, d):
    return table(spark, d, "lineitem")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, round(count({c}) * 100.0 / count(*), 2) AS percent, count(*) - count({c}) AS missing FROM {PO}" for c in _COLS))
def ag1_coverage(spark, d):
    return A.coverage(part_orders(spark, d), _COLS)


@query("SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity BETWEEN 10 AND 30) AS valid, count(DISTINCT l_orderkey) FILTER (l_quantity BETWEEN 10 AND 30) AS parents FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax BETWEEN 0.01 AND 0.05), count(DISTINCT l_orderkey) FILTER (l_tax BETWEEN 0.01 AND 0.05) FROM lineitem")
def ag2_coverage_by_parent(spark, d):
    return A.coverage_by_parent(lines(spark, d), {"l_quantity": (10, 30), "l_tax": (0.01, 0.05)}, "l_orderkey")


@query("SELECT source, n, round(CAST(n AS DOUBLE) / t, 4) AS share FROM (SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS t FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 10")
def ag3_value_counts(spark, d):
    return A.value_counts(table(spark, d, "documents"), "source", 10)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type || ' ' || p_brand, ' ')) AS tag FROM part) GROUP BY 1")
def ag4_tag_counts(spark, d):
    return A.tag_counts(table(spark, d, "part"), F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))


def _describe(c):
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 5) AS mean, round(quantile_cont({c}, 0.5), 5) AS median, round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.75), 5) AS q3, min({c}) AS least, max({c}) AS greatest, round(stddev_samp({c}), 5) AS deviation FROM lineitem"


@query(_describe("l_quantity") + " UNION ALL " + _describe("l_extendedprice"))
def ag5_describe_numeric(spark, d):
    return A.describe_numeric(lines(spark, d), ["l_quantity", "l_extendedprice"], 5)


@query("WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT CAST(p AS INTEGER) AS percent, v AS value FROM o JOIN (SELECT unnest([10, 50, 90, 99]) AS p) ON i = floor(n * p / 100)")
def ag6_percentile_by_index(spark, d):
    return A.percentile_by_index(table(spark, d, "orders"), "o_totalprice", [10, 50, 90, 99])


@query("SELECT CAST(c AS DOUBLE) AS cut, count(*) FILTER (o_totalprice >= c) AS n FROM orders, (SELECT unnest([1000, 50000, 100000, 200000, 400000]) AS c) GROUP BY 1")
def ag7_survival_counts(spark, d):
    return A.survival_counts(table(spark, d, "orders"), "o_totalprice", [1000, 50000, 100000, 200000, 400000])


@query("SELECT low, count(*) FILTER (value >= low AND (value < low + 20 OR low = 80 AND value <= 100)) AS n FROM events, (SELECT CAST(unnest([0, 20, 40, 60, 80]) AS DOUBLE) AS low) GROUP BY 1")
def ag8_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "value", [0, 20, 40, 60, 80, 100])


@query("""WITH c AS (SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS period, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(range((SELECT min(period) FROM c), (SELECT max(period) FROM c) + 1)) AS INTEGER) AS period)
SELECT period, coalesce(n, 0) AS n, period = (SELECT period FROM c ORDER BY n DESC, period LIMIT 1) AS peak FROM s LEFT JOIN c USING (period)""")
def ag9_counts_of_all_orders(spark, d):
    """All orders by day; only small tables have days without one."""
    return A.counts_with_gaps(table(spark, d, "orders"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")))


@query("SELECT CASE WHEN length(text) = 0 THEN 'none' WHEN length(text) < 100 THEN '1-99' WHEN length(text) < 300 THEN '100-299' WHEN length(text) < 500 THEN '300-499' ELSE '500+' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def ag10_length_buckets(spark, d):
    return A.length_buckets(table(spark, d, "documents"), "text", [100, 300, 500])


@query(f"SELECT key, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {PO}), 4) AS rate FROM (SELECT 'o_orderstatus' AS key FROM {PO} WHERE o_orderstatus IS NOT NULL UNION ALL SELECT 'l_returnflag' FROM {PO} WHERE l_returnflag IS NOT NULL) GROUP BY 1")
def ag11_fill_rates(spark, d):
    return A.fill_rates(part_orders(spark, d).select(C.filled_map(["o_orderstatus", "l_returnflag"]).alias("m")), "m")


@query("SELECT l_suppkey, count(l_quantity) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM lineitem GROUP BY 1 HAVING count(l_quantity) >= 20")
def ag12_group_medians(spark, d):
    return A.group_medians(lines(spark, d), "l_suppkey", "l_quantity", 20)


@query("""WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(mean), 4) AS mean, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""")
def ag13_box_stats(spark, d):
    return A.box_stats(lines(spark, d), "l_returnflag", "l_extendedprice")


@query("SELECT count(*) AS n, round(corr(l_quantity, ln(l_extendedprice)), 6) AS r FROM lineitem")
def ag14_log_pearson(spark, d):
    return A.log_pearson(lines(spark, d), "l_quantity", "l_extendedprice")


@query("WITH f AS (SELECT regr_slope(ln(l_extendedprice), l_quantity) AS b, regr_intercept(ln(l_extendedprice), l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT round(x, 6) AS x, round(exp(a + b * x), 3) AS y FROM (SELECT a, b, lo + (hi - lo) * i / 9 AS x FROM f, (SELECT unnest(range(10)) AS i))")
def ag15_log_trend(spark, d):
    return A.log_trend(lines(spark, d), "l_quantity", "l_extendedprice", 10)


_PAIRS = [("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_extendedprice"), ("l_discount", "l_discount"), ("l_discount", "l_extendedprice"), ("l_extendedprice", "l_extendedprice")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def ag16_corr_matrix(spark, d):
    return A.corr_matrix(lines(spark, d), ["l_quantity", "l_discount", "l_extendedprice"])


def _ceiling(level, keys):
    return f"SELECT '{level}' AS level, count(*) AS groups, round(greatest(0.0, 1 - sum(v * (n - 1)) / sum(n - 1) / (SELECT var_samp(ln(l_extendedprice)) FROM lineitem)), 6) AS ceiling FROM (SELECT count(*) AS n, coalesce(var_samp(ln(l_extendedprice)), 0) AS v FROM lineitem GROUP BY {keys} HAVING count(*) >= 3)"


@query(_ceiling("l_suppkey", "l_suppkey") + " UNION ALL " + _ceiling("l_suppkey+l_returnflag", "l_suppkey, l_returnflag") + " UNION ALL " + _ceiling("l_orderkey", "l_orderkey"))
def ag17_noise_ceiling(spark, d):
    return A.noise_ceiling(lines(spark, d), "l_extendedprice", [["l_suppkey"], ["l_suppkey", "l_returnflag"], ["l_orderkey"]])


def predictions(spark, d):
    return lines(spark, d).select("l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"), (F.col("l_orderkey") % 5).alias("fold"))


PRED = "(SELECT l_suppkey, l_extendedprice AS y, l_quantity * 1000 AS p, l_orderkey % 5 AS fold FROM lineitem)"
_METRICS = "count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(quantile_cont(abs(p - y), 0.5), 6) AS mdae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2, round(1 - sum((ln(p) - ln(y)) * (ln(p) - ln(y))) / (var_pop(ln(y)) * count(y)), 6) AS log_r2"


@query(f"SELECT n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, mdae, r2, log_r2 FROM (SELECT {_METRICS} FROM {PRED})")
def ag18_regression_metrics(spark, d):
    return A.regression_metrics(predictions(spark, d), "y", "p").withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3)})


@query(f"SELECT CASE WHEN y >= 50000 THEN 50000.0 WHEN y >= 10000 THEN 10000.0 WHEN y >= 0 THEN 0.0 END::DOUBLE AS low, count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(avg(abs(p - y) / y) * 100, 6) AS mape FROM {PRED} GROUP BY 1 HAVING count(*) >= 5")
def ag19_binned_metrics(spark, d):
    return A.binned_metrics(predictions(spark, d), "y", "p", [0, 10000, 50000]).select("low", "n", F.round("mae", 3).alias("mae"), "mape")


@query(f"SELECT low, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(1 - sum((ln(p) - ln(y)) * (ln(p) - ln(y))) / (var_pop(ln(y)) * count(y)), 5) AS log_r2 FROM (SELECT *, CASE WHEN y >= 30000 THEN 30000.0 WHEN y >= 10000 THEN 10000.0 ELSE 0.0 END::DOUBLE AS low FROM {PRED} WHERE y < 60000) GROUP BY 1 HAVING count(*) >= 5")
def ag19_binned_errors(spark, d):
    """The last bin ends at 60000."""
    return A.binned_metrics(predictions(spark, d), "y", "p", [0, 10000, 30000], last=60000).select("low", "n", F.round("rmse", 3).alias("rmse"), F.round("log_r2", 5).alias("log_r2"))


@query("""WITH o AS (SELECT o_orderpriority AS y, CASE WHEN o_totalprice > 200000 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN '2-HIGH' ELSE '5-LOW' END AS p FROM orders), c AS (SELECT y AS c FROM o UNION SELECT p FROM o), k AS (SELECT c, (SELECT count(*) FROM o WHERE y = c) AS t, (SELECT count(*) FROM o WHERE p = c) AS g, (SELECT count(*) FROM o WHERE y = c AND p = c) AS h FROM c)
SELECT round(CAST(sum(h) AS DOUBLE) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t + g > 0 THEN 2.0 * h / (t + g) ELSE 0 END), 6) AS macro_f1 FROM k""")
def ag20_classification_metrics(spark, d):
    p = F.when(F.col("o_totalprice") > 200000, "1-URGENT").when(F.col("o_totalprice") > 100000, "2-HIGH").otherwise("5-LOW")
    return A.classification_metrics(table(spark, d, "orders").select(F.col("o_orderpriority").alias("y"), p.alias("p")), "y", "p")


@query(f"SELECT round(avg(r), 6) AS mean_r2, round(stddev_pop(r), 6) AS deviation FROM (SELECT fold, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r FROM {PRED} GROUP BY 1)")
def ag21_fold_summary(spark, d):
    per = A.regression_metrics(predictions(spark, d), "y", "p", ["fold"])
    return per.agg(F.round(F.avg("r2"), 6).alias("mean_r2"), F.round(F.stddev_pop("r2"), 6).alias("deviation"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN l_extendedprice BETWEEN l_quantity * 500 AND l_quantity * 1500 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM lineitem")
def ag22_interval_coverage(spark, d):
    return A.interval_coverage(lines(spark, d).withColumns({"lo": F.col("l_quantity") * 500, "hi": F.col("l_quantity") * 1500}), "l_extendedprice", "lo", "hi")


@query("WITH n AS (SELECT l_partkey AS g, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n < 30 THEN 'other' ELSE CAST(g AS VARCHAR) END AS class, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1")
def ag23_fold_rare_parts(spark, d):
    """All lines by part: a part has 30 lines on the average at any size, those below fold."""
    classes = lines(spark, d).select(F.col("l_partkey").cast("string").alias("class"))
    return A.fold_rare(classes, "class", 30).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(quantile_cont(a, 0.5), 4) AS median_a, round(quantile_cont(b, 0.5), 4) AS median_b, round(quantile_cont(a - b, 0.5), 4) AS median_diff, round(avg(a - b), 4) AS mean_diff, CASE WHEN abs(quantile_cont(a - b, 0.5)) > 10 THEN 'biased' ELSE 'close' END AS verdict FROM (SELECT l_quantity AS a, p_size AS b FROM lineitem JOIN part ON l_partkey = p_partkey)")
def ag24_source_bias(spark, d):
    both = lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("p_size", F.col("p_size").cast("double"))
    return A.source_bias(both, "l_quantity", "p_size", 10)


@query("SELECT event_type, arg_max(round(value, 4), (ts, event_id)) AS latest FROM events WHERE value IS NOT NULL GROUP BY 1")
def ag25_latest_metric(spark, d):
    return A.latest_metric(table(spark, d, "events"), "event_type", F.round("value", 4), ["ts", "event_id"])


@query("SELECT count(*) AS n, round(100.0 * count(*) FILTER (lang = 'en') / count(*), 2) AS english, round(100.0 * count(*) FILTER (contains(text, 'example.com')) / count(*), 2) AS with_mail, round(100.0 * count(*) FILTER (length(text) > 0) / count(*), 2) AS with_text FROM documents")
def ag26_harvest_report(spark, d):
    checks = {"english": F.col("lang") == "en", "with_mail": F.contains("text", F.lit("example.com")), "with_text": F.length("text") > 0}
    return A.share_report(table(spark, d, "documents"), checks)


@query("SELECT (SELECT count(*) FROM orders) AS n, (SELECT round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 2) FROM orders) AS open, '{' || string_agg('\"' || y || '\":' || n, ',' ORDER BY y) || '}' AS last_years FROM (SELECT year(CAST(o_orderdate AS DATE)) AS y, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 3)")
def ag26_report_with_years(spark, d):
    report = A.share_report(table(spark, d, "orders"), {"open": F.col("o_orderstatus") == "O"}, F.year(F.col("o_orderdate").cast("date")), 3)
    return report.withColumn("last_years", F.to_json("last_years"))


@query("SELECT l_returnflag, round(sum(l_quantity * (1 - l_discount)) / (SELECT sum(l_quantity * (1 - l_discount)) FROM lineitem), 8) AS share FROM lineitem GROUP BY 1")
def ag27_evidence_share(spark, d):
    return A.evidence_share(lines(spark, d), "l_returnflag", F.col("l_quantity") * (1 - F.col("l_discount")))


@query(f"SELECT CAST((count(l_quantity) * 2 >= count(*))::INT + (count(o_totalprice) * 2 >= count(*))::INT AS BIGINT) AS dense, CAST((count(l_quantity) * 10 < count(*))::INT + (count(o_totalprice) * 10 < count(*))::INT AS BIGINT) AS sparse FROM {PO}")
def ag28_column_density(spark, d):
    return A.column_density(A.coverage(part_orders(spark, d), ["l_quantity", "o_totalprice"]))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, count(*) FILTER (event_type = 'purchase') AS ok, count(*) AS total FROM events GROUP BY 1 ORDER BY run DESC LIMIT 20")
def ag29_run_summary(spark, d):
    return A.run_summary(table(spark, d, "events"), F.col("ts").cast("date").cast("string"), F.col("event_type") == "purchase", 20)


@query("SELECT count(*) FILTER (o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 4 <> 0 THEN upper(o_orderstatus) END) AS changed, count(*) FILTER (o_orderkey % 4 = 0) AS nulled FROM orders")
def ag30_diff_counts(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return A.diff_counts(before, before.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.upper("o_orderstatus"))), "o_orderkey", "o_orderstatus")


@query("WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_type AS model, count(*) AS n FROM events GROUP BY 1, 2) SELECT session, model, n, n - lag(n) OVER (PARTITION BY model ORDER BY session) AS change FROM e")
def ag31_metric_history(spark, d):
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("session"), F.col("event_type").alias("model")).agg(F.count("*").alias("n"))
    return A.metric_history(e, "session", "model", "n")


@query("WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_type AS model, count(*) AS value FROM events GROUP BY 1, 2) SELECT session, model, value, value - lag(value) OVER (PARTITION BY model ORDER BY session) AS change FROM e")
def ag31_nested_history(spark, d):
    """Each session's metrics in one map, as a run's record holds them."""
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("session"), "event_type").agg(F.count("*").alias("n"))
    records = e.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("metrics"))
    return A.nested_history(records, "session", "metrics")


@query(f"SELECT o_orderpriority, key, count(*) AS n, round(CAST(count(*) AS DOUBLE) / any_value(t), 4) AS rate FROM (SELECT o_orderpriority, unnest([x FOR x IN [CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN o_orderstatus = 'O' OR l_returnflag = 'R' THEN 'either' END] IF x IS NOT NULL]) AS key FROM {PO}) JOIN (SELECT o_orderpriority, count(*) AS t FROM {PO} GROUP BY 1) USING (o_orderpriority) GROUP BY 1, 2")
def ag11_fill_rates_by_group(spark, d):
    orders = part_orders(spark, d).select("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "O").alias("open"), F.when(F.col("l_returnflag") == "R", "R").alias("returned"))
    return A.fill_rates(orders.select("o_orderpriority", C.filled_map(["open", "returned"]).alias("m")), "m", ["o_orderpriority"], {"either": ["open", "returned"]})
