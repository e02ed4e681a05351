"""Queries of filters, joins, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.operators import aggregates as A
from graintable.operators import relational as R
from graintable.operators.dedup import dedup_two_keys
from graintable.plans.base import query, table


def part_orders(spark, d):
    """Orders with the fields of each of their lines: null where an order has no line."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return table(spark, d, "orders").join(lines, "o_orderkey", "left")


PO = "(SELECT o.*, l_quantity, l_discount, l_tax, l_returnflag FROM orders o LEFT JOIN lineitem l ON o_orderkey = l_orderkey)"


@query(f"SELECT o_orderkey, CASE WHEN l_discount BETWEEN 0.05 AND 1 THEN l_discount WHEN l_tax IS NOT NULL THEN l_tax WHEN o_totalprice IS NOT NULL THEN o_totalprice END AS v, CASE WHEN l_discount BETWEEN 0.05 AND 1 THEN 'discount' WHEN l_tax IS NOT NULL THEN 'tax' WHEN o_totalprice IS NOT NULL THEN 'price' END AS source FROM {PO}")
def dv1_coalesce_with_source(spark, d):
    v, label = C.coalesce_with_source([(C.null_outside(F.col("l_discount"), 0.05, 1), "discount"), (F.col("l_tax"), "tax"), (F.col("o_totalprice"), "price")])
    return part_orders(spark, d).select("o_orderkey", v.alias("v"), label.alias("source"))


@query(f"SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'set' END, CASE WHEN l_tax IS NOT NULL THEN 'line' WHEN o_totalprice > 100000 THEN 'price' END) AS label FROM {PO}")
def dv2_backfill_label(spark, d):
    rules = [(F.col("l_tax").isNotNull(), "line"), (F.col("o_totalprice") > 100000, "price")]
    return part_orders(spark, d).select("o_orderkey", C.backfill_label(F.when(F.col("o_orderkey") % 2 == 0, "set"), rules).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_retailprice IS NULL OR l_extendedprice / l_quantity <= p_retailprice * 1.5 THEN l_extendedprice / l_quantity END AS unit_price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def dv3_null_if_inconsistent(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("u", F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", C.null_if_inconsistent(F.col("u"), F.col("p_retailprice"), 1.5).alias("unit_price"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 AND l_tax / l_discount BETWEEN 0.1 AND 2 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem")
def dv4_safe_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.safe_ratio(F.col("l_tax"), F.col("l_discount"), 0.1, 2), 6).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, round(ln(greatest(l_quantity, 10.0)), 6) AS v, round(l_quantity * l_extendedprice, 2) AS product FROM lineitem")
def dv5_dv6_log_and_product(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.log_clip(F.col("l_quantity"), 10.0), 6).alias("v"), F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).alias("product"))


@query(f"SELECT o_orderkey, CASE WHEN l_returnflag IS NOT NULL AND lower(trim(l_returnflag)) NOT IN ('n') THEN 1 ELSE 0 END AS has_flag, CASE WHEN l_tax IS NOT NULL THEN 1 ELSE 0 END AS has_tax FROM {PO}")
def dv7_present(spark, d):
    return part_orders(spark, d).select("o_orderkey", C.present(F.col("l_returnflag"), ["N"]).alias("has_flag"), C.present(F.col("l_tax")).alias("has_tax"))


@query(f"SELECT o_orderkey, round((CASE WHEN l_quantity IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN l_discount IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN o_totalprice IS NOT NULL THEN 4.0 ELSE 0 END) / 7.5 * 100, 1) AS score FROM {PO}")
def dv8_completeness(spark, d):
    return part_orders(spark, d).select("o_orderkey", C.completeness({"l_quantity": 2.0, "l_discount": 1.5, "o_totalprice": 4.0}).alias("score"))


@query("SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_suppkey NOT BETWEEN 10 AND 80 THEN 'l_suppkey=' || l_suppkey || '(range:10-80)' END, CASE WHEN l_linenumber NOT BETWEEN 1 AND 5 THEN 'l_linenumber=' || l_linenumber || '(range:1-5)' END) AS flags FROM lineitem")
def dv9_quality_flags(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.quality_flags({"l_suppkey": (10, 80), "l_linenumber": (1, 5)}).alias("flags"))


@query(f"SELECT o_orderkey, concat_ws('; ', 'status ' || o_orderstatus, 'priority ' || o_orderpriority || '.', 'flag ' || l_returnflag) AS summary FROM {PO}")
def dv10_summary_text(spark, d):
    return part_orders(spark, d).select("o_orderkey", C.summary_text([("o_orderstatus", "status {}"), ("o_orderpriority", "priority {}."), ("l_returnflag", "flag {}")]).alias("summary"))


@query(f"SELECT o_orderkey, '{{' || concat_ws(',', '\"o_orderstatus\":\"' || o_orderstatus || '\"', '\"l_returnflag\":\"' || l_returnflag || '\"') || '}}' AS filled FROM {PO}")
def dv11_filled_map(spark, d):
    return part_orders(spark, d).select("o_orderkey", F.to_json(C.filled_map(["o_orderstatus", "l_returnflag"])).alias("filled"))


@query("SELECT a.conv_id, a.turn, 'Reply to: ' || a.text AS instruction, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def dv12_to_pairs(spark, d):
    return R.to_pairs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "user", "Reply to: ")


@query(f"SELECT o_orderkey, coalesce(nullif(lower(trim(l_returnflag)), ''), 'unknown') AS flag, concat_ws(' · ', o_orderstatus, l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS label FROM {PO}")
def dv13_dv14_categories_and_labels(spark, d):
    label = C.row_label(["o_orderstatus", "l_returnflag", F.col("l_quantity").cast("long").cast("string")])
    return part_orders(spark, d).select("o_orderkey", C.norm_categorical(F.col("l_returnflag")).alias("flag"), label.alias("label"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber > 3 THEN (l_discount + l_tax) / 2 ELSE l_quantity END, 6) AS v FROM lineitem")
def dv15_resolve_range(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.resolve_range(F.col("l_quantity"), F.col("l_linenumber") > 3, F.col("l_discount"), F.col("l_tax")), 6).alias("v"))


# -- filters

@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license|rights reserved') OR regexp_matches(lower(text), 'password|token')")
def fl1_having_tags(spark, d):
    rules = (("legal", ("license", "rights reserved")), ("secret", ("password", "token")))
    return table(spark, d, "documents").where(F.size(C.tag_keywords(F.col("text"), rules)) > 0).select("doc_id")


@query(f"SELECT o_orderkey, l_returnflag FROM {PO} WHERE l_returnflag IN ('A', 'R')")
def fl2_allow(spark, d):
    return part_orders(spark, d).where(F.col("l_returnflag").isin("A", "R")).select("o_orderkey", "l_returnflag")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(d.n_chars, 0) >= 400 AND text <> '' AND (quality = 1) IS DISTINCT FROM false")
def fl3_quality_gate(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("good", F.col("quality") == 1)
    return R.quality_gate(docs, "n_chars", "text", "good", 400).select("doc_id")


@query("""SELECT doc_id, tier, tier IN ('keyword', 'no body', 'body') AS kept FROM (SELECT d.doc_id, CASE WHEN regexp_matches(lower(text), 'license') THEN 'keyword' WHEN NOT (lang = 'en') AND l.doc_id IS NULL THEN 'no children' WHEN source = 'src3' THEN 'other' WHEN h.body IS NULL THEN 'no body' WHEN regexp_matches(h.body, 'href') THEN 'body' ELSE 'off body' END AS tier
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT page_id AS doc_id, html AS body FROM pages) h ON h.doc_id = d.doc_id)""")
def fl4_tier_filter(spark, d):
    bodies = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("body"))
    return R.tier_filter(table(spark, d, "documents"), table(spark, d, "labels"), bodies, "doc_id", F.lower("text").rlike("license"), F.col("lang") == "en",
                         F.col("source") == "src3", F.col("body").rlike("href")).select("doc_id", "tier", "kept")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def fl5_delete_children(spark, d):
    removed = table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(removed, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), 'auto')) AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('O', 'F') AND c_acctbal >= 0")
def fl6_explore(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = dict(between=("o_totalprice", 1000, 300000), among=("o_orderstatus", ["O", "F"]), least=("c_acctbal", 0))
    return R.explore(both, "#0000001", ["c_name"], **a).unionByName(R.explore(both, "auto", ["c_mktsegment"], **a)).select("o_orderkey").distinct()


@query(f"SELECT o_orderkey FROM {PO} WHERE (l_quantity IS NOT NULL)::INT + (l_tax IS NOT NULL)::INT + (l_returnflag IS NOT NULL)::INT >= 2")
def fl7_min_present(spark, d):
    return R.min_present(part_orders(spark, d), ["l_quantity", "l_tax", "l_returnflag"], 2).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 300")
def fl8_min_length(spark, d):
    return table(spark, d, "documents").where(F.length(F.trim("text")) >= 300).select("doc_id")


@query("SELECT 'number' AS \"check\", count(*) FILTER (regexp_matches(text, '[0-9]{16}')) AS n FROM documents UNION ALL SELECT 'mail', count(*) FILTER (regexp_matches(text, '@')) FROM documents UNION ALL SELECT 'pure number', count(*) FILTER (regexp_matches(text, '^[0-9. ]+$')) FROM documents")
def fl9_suspicious_values(spark, d):
    return R.suspicious_values(table(spark, d, "documents"), "text", [("number", "[0-9]{16}"), ("mail", "@"), ("pure number", "^[0-9. ]+$")])


@query("SELECT count(l_extendedprice) AS filled, count(*) FILTER (l_extendedprice < 2000) AS below, count(*) FILTER (l_extendedprice > 50000) AS above, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99, max(l_extendedprice) AS greatest FROM lineitem")
def fl10_numeric_report(spark, d):
    return R.numeric_report(table(spark, d, "lineitem"), "l_extendedprice", 2000, 50000)


@query(f"SELECT o_orderkey FROM {PO} WHERE l_quantity IS NOT NULL AND l_discount > 0 AND o_orderpriority = '2-HIGH'")
def fl11_filter_samples(spark, d):
    return R.filter_samples(part_orders(spark, d), ["l_quantity"], ["l_discount"], {"o_orderpriority": "2-HIGH"}).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (quality IS NULL OR toxic IS NULL) AND d.doc_id IN (SELECT page_id FROM pages)")
def fl12_select_incomplete(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return R.select_incomplete(docs, ["quality", "toxic"], table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id").select("doc_id")


# -- joins

@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 2 THEN l_returnflag END, o_orderstatus) AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def jn1_fill_from(spark, d):
    child = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("status"))
    parent = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return R.fill_from(child, parent, "l_orderkey", ["status"], "o_orderdate")


@query("SELECT 'status' AS \"column\", count(coalesce(CASE WHEN l_linenumber > 2 THEN l_returnflag END, o_orderstatus)) - count(CASE WHEN l_linenumber > 2 THEN l_returnflag END) AS filled FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def jn1_filled_counts(spark, d):
    child = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("status"))
    parent = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return R.filled_counts(child, R.fill_from(child, parent, "l_orderkey", ["status"], "o_orderdate"), ["status"])


@query("SELECT o_orderkey, coalesce(x, o_orderstatus) AS o_orderstatus, x IS DISTINCT FROM NULL AND x <> o_orderstatus AS changed_ FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag || l_linenumber, (l_shipdate, l_linenumber, l_returnflag || l_linenumber)) AS x FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def jn3_patch_with_repeated_keys(spark, d):
    """Each order has several patch rows: the one shipped last counts."""
    patch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linenumber").alias("o_orderstatus"), "l_shipdate", "l_linenumber")
    patch = patch.withColumn("at", F.struct("l_shipdate", "l_linenumber", "o_orderstatus"))
    return R.apply_patch(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), patch, "o_orderkey", ["o_orderstatus"], order="at")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END, f) AS discount FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_discount, (l_linenumber, l_discount)) AS f FROM lineitem WHERE l_discount > 0 GROUP BY 1) ON o_orderkey = l_orderkey")
def jn2_fill_from_first(spark, d):
    parent = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.5)).alias("discount"))
    child = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("discount"), "l_linenumber")
    return R.fill_from_first(parent, child, "o_orderkey", "discount", F.struct("l_linenumber", "discount"), F.col("discount") > 0)


def _patch(spark, d):
    orders = table(spark, d, "orders")
    return orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")).alias("o_orderstatus"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, (o_orderkey % 6 = 0 AND o_orderstatus <> 'X') AS changed_ FROM orders")
def jn3_apply_patch(spark, d):
    return R.apply_patch(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _patch(spark, d), "o_orderkey", ["o_orderstatus"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus WHEN o_orderkey % 6 = 0 THEN 'X' END AS o_orderstatus, (o_orderstatus = 'F' AND o_orderkey % 6 = 0) AS changed_ FROM orders")
def jn4_patch_fill(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus"))
    return R.apply_patch(base, _patch(spark, d), "o_orderkey", ["o_orderstatus"], mode="fill")


@query("""SELECT d.doc_id, CASE WHEN lang <> 'en' THEN lang ELSE coalesce(CASE WHEN d.doc_id % 5 = 0 THEN 'cached' END, CASE WHEN regexp_matches(substring(lower(text), 1, 200), 'license') THEN 'head' END, CASE WHEN regexp_matches(lower(text), 'license') THEN 'body' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, 'unidentified') END AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn5_recover(spark, d):
    docs = table(spark, d, "documents")
    base = docs.select("doc_id", F.when(F.col("lang") == "en", "other").otherwise(F.col("lang")).alias("value"))
    cache = docs.where("doc_id % 5 = 0").select("doc_id", F.lit("cached").alias("value"))
    tags = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"))
    low = F.lower("text")
    return R.recover(base, "doc_id", "value", cache, docs.select("doc_id", "text"), tags, F.when(F.substring(low, 1, 200).rlike("license"), "head"), F.when(low.rlike("license"), "body"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality IN (0, 1) AND lang = 'en' THEN 'q' || l.quality END, lang) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn6_rescue(spark, d):
    cache = table(spark, d, "labels").where("quality in (0, 1)").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("value"))
    return R.rescue(table(spark, d, "documents").select("doc_id", F.col("lang").alias("value")), "doc_id", "value", F.col("value") == "en", cache)


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def jn7_flag_in(spark, d):
    return R.flag_in(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "labelled")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def jn8_new_only(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jn9_with_text(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'text' WHEN doc_id IN (SELECT page_id FROM pages) THEN 'file only' WHEN lang = 'en' THEN 'abstract only' ELSE 'none' END AS class, count(*) AS n FROM documents GROUP BY 1")
def jn10_availability(spark, d):
    docs = table(spark, d, "documents").withColumn("abstract", F.when(F.col("lang") == "en", F.col("text")))
    return R.availability(docs, table(spark, d, "labels"), table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "abstract")


@query("SELECT p_partkey, target, round(exp(-((p_size - target) * (p_size - target)) / 200.0), 6) AS score FROM part CROSS JOIN (SELECT r_regionkey * 10 AS target FROM region)")
def jn13_score_targets(spark, d):
    targets = table(spark, d, "region").select((F.col("r_regionkey") * 10).alias("target"))
    s = F.round(F.exp(-((F.col("p_size") - F.col("target")) * (F.col("p_size") - F.col("target"))) / 200.0), 6)
    return R.score_targets(table(spark, d, "part"), targets, s).select("p_partkey", "target", "score")


@query("SELECT count(*) AS n, round(quantile_cont(l_extendedprice / l_quantity - p_retailprice, 0.5), 6) AS median_diff FROM lineitem JOIN part ON l_partkey = p_partkey")
def jn14_paired_diff(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.paired_diff(both, F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 0) JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 <> 0) USING (o_custkey)")
def jn15_leakage(spark, d):
    orders = table(spark, d, "orders")
    return R.leakage(orders.where("o_orderkey % 5 = 0"), orders.where("o_orderkey % 5 <> 0"), "o_custkey")


_OOF = "(SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS y, o_orderkey % 5 AS fold FROM orders)"


@query(f"""WITH o AS {_OOF}, c AS (SELECT fold, o_custkey, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT o_custkey, sum(s) AS ks, sum(n) AS kn FROM c GROUP BY 1), f AS (SELECT fold, sum(s) AS fs, sum(n) AS fn FROM c GROUP BY 1), t AS (SELECT sum(fs) AS ts, sum(fn) AS tn FROM f)
SELECT o_orderkey, coalesce(CASE WHEN kn > n THEN CAST(ks - s AS DOUBLE) / (kn - n) END, CAST(ts - fs AS DOUBLE) / (tn - fn)) AS oof_mean FROM o JOIN c USING (fold, o_custkey) JOIN k USING (o_custkey) JOIN f USING (fold), t""")
def jn16_oof_group_mean(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("y"), (F.col("o_orderkey") % 5).alias("fold"))
    return R.oof_group_mean(o, "fold", "o_custkey", "y").select("o_orderkey", "oof_mean")


@query("SELECT p_partkey, CASE p_type WHEN 'STEEL' THEN 0 WHEN 'COPPER' THEN 1 ELSE 2 END AS code FROM part")
def jn17_encode(spark, d):
    vocab = spark.createDataFrame([("STEEL", 0), ("COPPER", 1)], "value string, code int")
    return R.encode(table(spark, d, "part"), "p_type", vocab, "code", 2).select("p_partkey", "code")


# -- windows, sorts, sets

@query("SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR text = ''")
def wn1_dedup_two_keys(spark, d):
    return dedup_two_keys(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["doc_id"]).select("doc_id")


_ROUND = """SELECT a, b, o, CASE WHEN o = m1 AND (b IS NULL OR o = m2) THEN 1 ELSE 0 END AS kept FROM (SELECT *, min(o) OVER (PARTITION BY a) AS m1, min(o) OVER (PARTITION BY b) AS m2 FROM {open})"""


@query(f"""WITH RECURSIVE pairs AS (SELECT l_partkey AS a, CASE WHEN l_discount > 0 THEN l_suppkey END AS b, row_number() OVER (ORDER BY min((l_orderkey, l_linenumber, l_suppkey)), l_partkey) AS o FROM lineitem GROUP BY 1, 2),
rounds AS (SELECT a, b, o, 0 AS kept FROM pairs UNION ALL SELECT a, b, o, kept FROM (SELECT *, max(kept) OVER (PARTITION BY a) AS gone1, CASE WHEN b IS NULL THEN 0 ELSE max(kept) OVER (PARTITION BY b) END AS gone2 FROM ({_ROUND.format(open="(SELECT a, b, o FROM rounds WHERE kept = 0)")})) WHERE kept = 1 OR gone1 + gone2 = 0)
SELECT a AS l_partkey, b AS claimed FROM rounds WHERE kept = 1""")
def wn1_greedy_two_keys(spark, d):
    """Parts and suppliers matched in the order of lines: each part once, each supplier once; lines without a discount name no supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0, F.col("l_suppkey")).alias("claimed"))
    return dedup_two_keys(lines, "l_partkey", "claimed", ["l_orderkey", "l_linenumber", "l_suppkey"], small=1_000).select("l_partkey", "claimed")


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def wn2_diverse_top_k(spark, d):
    return R.diverse_top_k(table(spark, d, "part"), F.col("p_retailprice"), ["p_brand"], 2, 20, "p_partkey").select("p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_discount > 0.05) DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def wn3_cap_per_key(spark, d):
    return R.cap_per_key(table(spark, d, "lineitem"), "l_orderkey", 3, F.col("l_discount") > 0.05, "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id FROM customer")
def wn4_assign_ids(spark, d):
    return R.assign_ids(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier"), "s_suppkey", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, string_agg(l_returnflag, ' ') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS context FROM lineitem")
def wn5_look_back(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(-2, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.collect_list("l_returnflag").over(w)).alias("context"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def wn6_first_per_key(spark, d):
    return R.first_per_key(table(spark, d, "lineitem"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 52")
def wn7_retain_last(spark, d):
    return R.top_k(table(spark, d, "events"), 52, F.col("ts").desc(), F.col("event_id").desc()).select("event_id")


@query("SELECT date, event_type, n FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN -1 ELSE count(*) END AS n FROM events GROUP BY CAST(ts AS DATE), event_type)")
def wn8_upsert(spark, d):
    events = table(spark, d, "events")
    daily = events.groupBy(F.col("ts").cast("date").cast("string").alias("date"), "event_type").agg(F.count("*").alias("n"))
    least = events.agg(F.min("event_type").alias("event_type"))
    return R.upsert(daily, daily.join(least, "event_type", "left_semi").withColumn("n", F.lit(-1).cast("long")), ["date", "event_type"])


@query(r"SELECT doc_id FROM (SELECT doc_id, bare, row_number() OVER (PARTITION BY bare ORDER BY doc_id) AS r FROM (SELECT doc_id, coalesce(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '') AS bare FROM documents)) WHERE r = 1 OR bare = ''")
def wn9_dedup_by_title(spark, d):
    return R.dedup_by_title(table(spark, d, "documents").select("doc_id", "text"), "text", [F.col("doc_id")]).select("doc_id")


@query(f"SELECT o_orderkey FROM {PO} ORDER BY coalesce(l_discount, 0) DESC, o_orderkey LIMIT 100")
def st1_sort_null_as_zero(spark, d):
    return R.top_k(part_orders(spark, d), 100, F.coalesce("l_discount", F.lit(0)).desc(), F.col("o_orderkey")).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {PO} ORDER BY l_quantity ASC NULLS LAST, o_orderkey LIMIT 100")
def st2_sort_nulls_last(spark, d):
    return R.top_k(part_orders(spark, d), 100, F.asc_nulls_last("l_quantity"), F.col("o_orderkey")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def st3_top_k(spark, d):
    return R.top_k(table(spark, d, "lineitem"), 50, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5(o_custkey || ':7'), o_custkey LIMIT 100")
def st4_sample_keys(spark, d):
    return R.sample_keys(table(spark, d, "orders"), "o_custkey", 100, 7)


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def so1_union_align(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.union_align(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def so2_keys_minus(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).subtract(table(spark, d, "lineitem").select("l_orderkey"))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def so3_keys_union(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return a.union(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")).distinct()


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def so4_keys_intersect(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return a.intersect(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT key, name FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))")
def so5_append_new(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return R.append_new(base, table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), "key")
