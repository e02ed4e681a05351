"""Queries of the modelling jobs; those with SQL are exact, the others are held to bounds in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.operators import modelling as M
from graintable.operators.aggregates import long_form
from graintable.operators.quantiles import quantiles
from graintable.plans.base import query, table

NUMERIC, CATEGORICAL = ["p_size", "quantity", "discount"], ["p_type"]
_SAMPLES = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_type, p_brand, quantity, discount, price FROM part JOIN (SELECT l_partkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"
_FOLD = "CAST(('0x' || substring(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % {n} AS INTEGER)"


def samples(spark, d):
    """A part's mean line as a sample: price to predict, part features, parent brand."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_type", "p_brand")
    return parts.join(lines, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")


@query(f"SELECT o_orderkey, {_FOLD.format(k='o_custkey', n=5)} AS fold FROM orders")
def ml1_group_folds(spark, d):
    return M.assign_group_folds(table(spark, d, "orders"), "o_custkey", 5).select("o_orderkey", "fold")


@query(f"SELECT o_orderkey, {_FOLD.format(k='o_custkey', n=100)} < 15 AS held_out FROM orders")
def ml2_group_holdout(spark, d):
    return M.group_holdout(table(spark, d, "orders"), "o_custkey", 15).select("o_orderkey", "held_out")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS g, CAST(o_totalprice AS DECIMAL(12,2)) AS y, o_orderkey % 5 AS fold FROM orders), c AS (SELECT fold, g, sum(y)::DOUBLE AS s, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT g, sum(s) AS ks, sum(n) AS kn FROM c GROUP BY 1), f AS (SELECT fold, sum(s) AS fs, sum(n) AS fn FROM c GROUP BY 1), t AS (SELECT sum(fs) AS ts, sum(fn) AS tn FROM f)
SELECT o_orderkey, round((ks - s + (ts - fs) / (tn - fn) * 10) / (kn - n + 10), 3) AS encoded FROM o JOIN c USING (fold, g) JOIN k USING (g) JOIN f USING (fold), t""")
def ml3_target_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").cast("decimal(12,2)").alias("y"), (F.col("o_orderkey") % 5).alias("fold"))
    return M.target_encode(o, "fold", "g", "y", 10).select("o_orderkey", F.round("encoded", 3).alias("encoded"))


@query()
def ml4_fit_regressor(spark, d):
    return M.cross_validate(samples(spark, d), "price", NUMERIC, CATEGORICAL, "p_brand", 3)


@query(f"SELECT fold, count(*) AS n, true AS finite, true AS within FROM (SELECT {_FOLD.format(k='p_brand', n=3)} AS fold FROM {_SAMPLES} WHERE price > 0) GROUP BY 1")
def ml4_folds_within_bounds(spark, d):
    """Each fold is predicted once, by models of the other folds' brands, within bounds."""
    found = ml4_fit_regressor(spark, d)
    return found.select("fold", "n", (F.col("mae") < float("inf")).alias("finite"), F.col("log_r2").between(-1, 1).alias("within"))


@query(f"SELECT count(*) AS n, true AS known_classes, true AS shares FROM {_SAMPLES}")
def ml5_classes_within_bounds(spark, d):
    """Every part gets a known class, with a share between that of chance and 1."""
    types = samples(spark, d).select("p_type").distinct().count()
    known = F.col("class").between(0, types)  # one more for unknown labels
    sure = F.col("sure").between(1.0 / (types + 1) - 1e-6, 1)
    return ml5_fit_classifier(spark, d).agg(F.count("*").alias("n"), F.every(known).alias("known_classes"), F.every(sure).alias("shares"))


@query()
def ml5_fit_classifier(spark, d):
    data = samples(spark, d)
    model = M.fit_classifier(data, "p_type", ["p_size", "quantity", "price"])
    scored = model.transform(M.with_missing(data, ["p_size", "quantity", "price"], ()))
    return scored.select("p_partkey", F.col("prediction").cast("int").alias("class"), F.round(F.array_max(M.class_probabilities(scored)), 6).alias("sure"))


@query()
def ml6_permutation_importance(spark, d):
    data = M.group_holdout(samples(spark, d), "p_partkey", 30)
    model = M.fit_regressor(data.where("not held_out"), "price", NUMERIC, CATEGORICAL, rounds=5)
    return M.permutation_importance(model, data.where("held_out").drop("held_out"), "price", NUMERIC, CATEGORICAL, ["quantity", "p_size"], 2)


@query("SELECT 'quantity' AS first, true AS helps")
def ml6_driver_comes_first(spark, d):
    """The price follows the quantity, so that column costs the most when it changes places."""
    found = ml6_permutation_importance(spark, d)
    return found.agg(F.max_by("column", "importance").alias("first"), (F.max("importance") > 0).alias("helps"))


@query()
def ml7_generate_candidates(spark, d):
    return M.generate_candidates(samples(spark, d), 5000, NUMERIC, CATEGORICAL, 7)


@query(f"SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS in_range, CAST(5000 AS BIGINT) AS known, count(DISTINCT p_type) AS types FROM {_SAMPLES}")
def ml7_candidates_hold_their_bounds(spark, d):
    """Of 5,000 candidates: how many lie within the quantiles, have a known type, and how many types there are."""
    data = samples(spark, d)
    made = M.generate_candidates(data, 5000, NUMERIC, CATEGORICAL, 7)
    bounds = {r["column"]: r["q"] for r in quantiles(long_form(data, NUMERIC), "x", [0.05, 0.95], ["column"]).collect()}
    inside = F.lit(True)
    for c in NUMERIC:
        inside = inside & F.col(c).between(*bounds[c])
    types = data.select("p_type").distinct().withColumn("known", F.lit(True))
    return made.join(types, "p_type", "left").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_range"), F.count_if("known").alias("known"), F.count_distinct("p_type").alias("types"))


@query(f"SELECT p_type, 20::BIGINT AS n, 20::BIGINT AS own FROM (SELECT DISTINCT p_type FROM {_SAMPLES})")
def ml7_candidate_pools(spark, d):
    """The 20 best of 200 candidates a type, each from its type's own brands."""
    data = samples(spark, d)
    pools = M.candidate_pools(data, "p_type", data, 200, 20, NUMERIC, ["p_brand"], 3, M.closeness(F.col("quantity"), 20.0))
    own = data.select("p_type", "p_brand").distinct().withColumn("own", F.lit(True))
    return pools.join(own, ["p_type", "p_brand"], "left").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


_DRAWS = "SELECT o_orderkey, ['A', 'N', 'R'][1 + o_orderkey % 3] AS l_returnflag, (o_orderkey % 9973 + 0.5) / 9973.0 AS u FROM orders"


def draws(spark, d):
    """A place from 0 up to 1 within one of three groups for each order."""
    flag = F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", flag.alias("l_returnflag"), ((F.col("o_orderkey") % 9973 + F.lit(0.5)) / F.lit(9973.0)).alias("u"))


@query(f"""WITH d AS ({_DRAWS}), v AS (SELECT l_returnflag, l_partkey, sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS upto, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, l_partkey FROM d JOIN t USING (l_returnflag) JOIN v ON v.l_returnflag = d.l_returnflag AND floor(u::DOUBLE * total) < upto AND floor(u::DOUBLE * total) >= upto - n""")
def ml7_weighted_draws(spark, d):
    """A part for each order, drawn as often as the group's lines have it."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    return M.draw_values(draws(spark, d), lines, "l_partkey", ["l_returnflag"], weighted=True).select("o_orderkey", "l_partkey")


@query(f"""WITH d AS ({_DRAWS}), c AS (SELECT l_returnflag, CAST(l_suppkey AS VARCHAR) AS supplier, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag, supplier FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, supplier) AS r FROM c) WHERE r <= 7
UNION ALL SELECT DISTINCT l_returnflag, 'unknown' FROM lineitem), v AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY supplier) - 1 AS i FROM b)
SELECT o_orderkey, supplier FROM d JOIN v ON v.l_returnflag = d.l_returnflag AND i = floor(u::DOUBLE * 8)""")
def ml7_draws_of_the_most_frequent(spark, d):
    """A supplier for each order from its group's seven most frequent ones and 'unknown', all as likely."""
    lines = table(spark, d, "lineitem").select("l_returnflag", F.col("l_suppkey").cast("string").alias("supplier"))
    return M.draw_values(draws(spark, d), lines, "supplier", ["l_returnflag"], top=7, extra="unknown").select("o_orderkey", "supplier")


@query("SELECT p_partkey, round(exp(-((ln(p_retailprice) - ln(1200.0)) * (ln(p_retailprice) - ln(1200.0))) / (2 * 0.3 * 0.3)) * (p_size / 50.0), 8) AS score FROM part ORDER BY exp(-((ln(p_retailprice) - ln(1200.0)) * (ln(p_retailprice) - ln(1200.0))) / (2 * 0.3 * 0.3)) * (p_size / 50.0) DESC, p_partkey LIMIT 25")
def ml8_inverse_design(spark, d):
    given = table(spark, d, "part").withColumn("chance", F.col("p_size") / 50.0)
    return M.inverse_design(given, "p_retailprice", 1200.0, 25, "p_partkey", "chance").select("p_partkey", F.round("score", 8).alias("score"))


def _sql_cdf(z):
    t = f"(1.0 / (1.0 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    tail = f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}) * exp(-(abs({z}) / sqrt(2.0)) * (abs({z}) / sqrt(2.0)))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 + 0.5 * (1 - {tail}) ELSE 0.5 - 0.5 * (1 - {tail}) END)"


@query("SELECT p_partkey, p_size / 50.0 AS score FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def ml8_by_label_alone(spark, d):
    """Without a target the class probability decides."""
    given = table(spark, d, "part").withColumn("chance", F.col("p_size") / 50.0)
    return M.inverse_design(given, None, None, 25, "p_partkey", "chance").select("p_partkey", "score")


@query(f"""WITH q AS (SELECT p_partkey, ln(p_retailprice * 0.8) AS a, ln(p_retailprice) AS b, ln(p_retailprice * 1.3) AS c FROM part), z AS (SELECT *, (ln(1200.0) + ln(1.25) - b) / greatest((c - a) / 3.92, 0.01) AS z1, (ln(1200.0) - ln(1.25) - b) / greatest((c - a) / 3.92, 0.01) AS z2 FROM q)
SELECT p_partkey, round((CASE WHEN ln(1200.0) BETWEEN a AND c THEN 2.0 ELSE 0.0 END) + {_sql_cdf('z1')} - {_sql_cdf('z2')} - 0.25 * (c - a), 6) AS interval_score FROM z""")
def ml9_interval_score(spark, d):
    given = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 0.8).alias("lo"), F.col("p_retailprice").alias("mid"), (F.col("p_retailprice") * 1.3).alias("hi"))
    return M.interval_score(given, "lo", "mid", "hi", 1200.0).select("p_partkey", F.round("interval_score", 6).alias("interval_score"))


_SOLVED = """WITH s AS (SELECT l_returnflag AS g, count(*) AS n, sum(l_quantity) AS x, sum(l_discount) AS d, sum(l_quantity * l_quantity) + 1.0 AS xx, sum(l_discount * l_discount) + 1.0 AS dd, sum(l_quantity * l_discount) AS xd, sum(l_extendedprice) AS y, sum(l_quantity * l_extendedprice) AS xy, sum(l_discount * l_extendedprice) AS dy FROM lineitem GROUP BY 1 HAVING count(*) >= 80 AND count(DISTINCT l_orderkey) >= 3),
t AS (SELECT *, n * (xx * dd - xd * xd) - x * (x * dd - xd * d) + d * (x * xd - xx * d) AS det FROM s)
SELECT g AS l_returnflag, n, round((y * (xx * dd - xd * xd) - x * (xy * dd - xd * dy) + d * (xy * xd - xx * dy)) / det, 3) AS intercept, round((n * (xy * dd - xd * dy) - y * (x * dd - xd * d) + d * (x * dy - xy * d)) / det, 4) AS quantity, round((n * (xx * dy - xy * xd) - x * (x * dy - xy * d) + y * (x * xd - xx * d)) / det, 3) AS discount FROM t"""


@query(_SOLVED)
def ml10_fit_per_group(spark, d):
    """Weights of a ridge fit a group; the SQL solves the same three equations by determinants."""
    lines = table(spark, d, "lineitem")
    found = M.fit_per_group(lines, "l_returnflag", "l_orderkey", ["l_quantity", "l_discount"], "l_extendedprice", 80, 3)
    w = F.col("weights")
    return found.select("l_returnflag", "n", F.round(w[0], 3).alias("intercept"), F.round(w[1], 4).alias("quantity"), F.round(w[2], 3).alias("discount"))


@query("SELECT o_orderkey, round(e, 8) AS entropy FROM (SELECT o_orderkey, -(p * ln(p + 1e-12)) - ((1 - p) * ln(1 - p + 1e-12)) AS e FROM (SELECT o_orderkey, o_totalprice / 600000.0 AS p FROM orders)) ORDER BY e DESC, o_orderkey LIMIT 40")
def ml11_most_uncertain(spark, d):
    given = table(spark, d, "orders").withColumn("p", F.col("o_totalprice") / 600000.0)
    return M.most_uncertain(given, F.array("p", 1 - F.col("p")), 40, "o_orderkey").select("o_orderkey", F.round("entropy", 8).alias("entropy"))


@query()
def ml12_most_uncertain_sigma(spark, d):
    data = samples(spark, d)
    models = [M.fit_regressor(data.where(F.pmod(F.xxhash64("p_partkey", F.lit(i)), F.lit(3)) != 0), "price", NUMERIC, rounds=3) for i in range(3)]
    out = data
    for i, m in enumerate(models):
        out = M.predict(m, out, NUMERIC).withColumnRenamed("p", f"p{i}")
    return M.most_uncertain_sigma(out, ["p0", "p1", "p2"], 20, "p_partkey").select("p_partkey", "sigma", "low", "high")


@query(f"SELECT least(20, count(*)) AS n, true AS ordered, true AS spread FROM {_SAMPLES}")
def ml12_sigma_within_bounds(spark, d):
    """Twenty parts, their bounds around the mean by one spread, which isn't negative."""
    found = ml12_most_uncertain_sigma(spark, d)
    width = F.abs(F.log(F.col("high") / F.col("low")) - 2 * F.col("sigma")) < 1e-9
    return found.agg(F.count("*").alias("n"), F.every((F.col("low") <= F.col("high")) & width).alias("ordered"), F.every(F.col("sigma") >= 0).alias("spread"))


@query("SELECT l_orderkey, l_linenumber, round(1.0 / (abs(l_quantity - 25) + 1e-3) / (l_discount + 1e-3), 4) AS score FROM lineitem")
def ml13_closeness_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.closeness_score(F.col("l_quantity"), F.col("l_discount"), 25.0), 4).alias("score"))


@query()
def ml14_tune(spark, d):
    return M.tune(samples(spark, d), "price", NUMERIC, "p_brand", {"regParam": [0.0, 0.1, 1.0]})


@query(f"SELECT unnest(['regParam=0.0', 'regParam=0.1', 'regParam=1.0']) AS point, true AS within FROM (SELECT stddev_pop(ln(price)) AS s FROM {_SAMPLES} WHERE price > 0)")
def ml14_points_within_bounds(spark, d):
    """Every grid point has an error, and none is much worse than the spread of the target itself."""
    spread = samples(spark, d).where("price > 0").agg(F.stddev_pop(F.log("price"))).first()[0]
    return ml14_tune(spark, d).select("point", F.col("rmse").between(0, 1.5 * spread).alias("within"))


GRID = [{"rounds": 1, "depth": 1}, {"rounds": 2, "depth": 2}, {"rounds": 6, "depth": 3}]


@query()
def ml14_halving(spark, d):
    return M.halving(samples(spark, d), "price", NUMERIC, CATEGORICAL, "p_partkey", GRID, 2, (30, 100))


@query(f"""WITH s AS (SELECT {_FOLD.format(k="(p_partkey || ':rung')", n=100)} AS part FROM {_SAMPLES} WHERE price > 0)
SELECT 1 AS rung, count(*) FILTER (part < 30) AS rows, 3::BIGINT AS points, 2::BIGINT AS kept FROM s UNION ALL SELECT 2, count(*), 2, 1 FROM s""")
def ml14_rungs(spark, d):
    """Points, rows and survivors of each rung."""
    return ml14_halving(spark, d).groupBy("rung").agg(F.max("rows").alias("rows"), F.count("*").alias("points"), F.count_if("kept").alias("kept"))


@query("SELECT l_returnflag, count(*) AS n, round(quantile_cont(abs(l_extendedprice - l_quantity * 1000), 0.9), 4) AS half FROM lineitem GROUP BY 1")
def ml15_conformal_interval(spark, d):
    given = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return M.conformal_interval(given, "l_extendedprice", "p", "l_returnflag", 0.1).withColumn("half", F.round("half", 4))


@query()
def ml16_ablation(spark, d):
    return M.ablation(samples(spark, d), "price", "p_type", NUMERIC, "p_brand", subset=["quantity"], categorical=CATEGORICAL)


_HELD = _FOLD.format(k="p_brand", n=100)


@query(f"""WITH s AS (SELECT *, {_HELD} < 20 AS held FROM {_SAMPLES} WHERE price > 0), m AS (SELECT p_type, avg(price) AS g FROM s WHERE NOT held GROUP BY 1), a AS (SELECT avg(price) AS a FROM s WHERE NOT held)
SELECT 'global mean' AS model, round(avg(abs(price - a)), 3) AS mae FROM s, a WHERE held UNION ALL SELECT 'group mean', round(avg(abs(price - coalesce(g, a))), 3) FROM s LEFT JOIN m USING (p_type), a WHERE held""")
def ml16_mean_rungs(spark, d):
    """The ladder's two lowest rungs, which SQL can say."""
    rungs = M.ablation(samples(spark, d), "price", "p_type", NUMERIC, "p_brand")
    return rungs.where("model like '% mean'").select("model", F.round("mae", 3).alias("mae"))


@query("SELECT l_returnflag AS model, round(corr(l_quantity, l_extendedprice), 6) AS log_r2, CASE WHEN l_returnflag <> 'N' THEN 0.9 END::DOUBLE AS recorded, CASE WHEN l_returnflag <> 'N' THEN abs(round(corr(l_quantity, l_extendedprice), 6) - 0.9) > 0.05 ELSE false END AS flag FROM lineitem GROUP BY 1")
def ml17_compare_same_split(spark, d):
    lines = table(spark, d, "lineitem")
    metrics = lines.groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("log_r2"))
    recorded = metrics.where("model <> 'N'").select("model", F.lit(0.9).cast("double").alias("log_r2"))
    return M.compare_same_split(metrics, recorded)


@query("""WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p1, l_quantity * 1500 AS p2 FROM lineitem WHERE """+_FOLD.format(k="l_orderkey", n=100)+""" < 20), m AS (SELECT unnest(['a', 'b']) AS model, unnest([p1, p2]) AS p, y FROM t)
SELECT model, count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(1 - sum((ln(p) - ln(y)) * (ln(p) - ln(y))) / (var_pop(ln(y)) * count(y)), 5) AS log_r2 FROM m GROUP BY 1""")
def ml17_models_on_one_split(spark, d):
    """Two predictions of the same held-out lines."""
    test = M.group_holdout(table(spark, d, "lineitem"), "l_orderkey", 20).where("held_out")
    both = M.models_on_one_split(test, "l_extendedprice", {"a": F.col("l_quantity") * 1000, "b": F.col("l_quantity") * 1500})
    return both.select("model", "n", F.round("mae", 3).alias("mae"), F.round("log_r2", 5).alias("log_r2"))


@query("SELECT d.doc_id, lang, concat_ws('; ', CASE WHEN regexp_matches(lower(text), 'license|rights reserved') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), 'password|token') THEN 'secret' END) AS tags, round((CASE WHEN text IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0 END) / 3.0 * 100, 1) AS score, CASE WHEN regexp_matches(lower(text), 'license') THEN 'keyword' WHEN quality IS NULL AND lang <> 'en' THEN 'unlabelled' ELSE 'body' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id)")
def flagship(spark, d):
    """Documents joined to their labels: tagged, scored for completeness, and put in a tier."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = (("legal", ("license", "rights reserved")), ("secret", ("password", "token")))
    tier = F.when(F.lower("text").rlike("license"), "keyword").when(F.col("quality").isNull() & (F.col("lang") != "en"), "unlabelled").otherwise("body")
    return docs.select("doc_id", "lang", F.array_join(C.tag_keywords(F.col("text"), rules), "; ").alias("tags"), C.completeness({"text": 2.0, "quality": 1.0}).alias("score"), tier.alias("tier"))
