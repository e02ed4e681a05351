"""Queries of the text extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.operators import extract as X
from graintable.plans.base import query, table

_S = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1))"
_SENT = f"SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_S} AS l FROM documents)"


def docs(spark, d):
    return table(spark, d, "documents")


@query("""SELECT doc_id, coalesce(CASE WHEN a BETWEEN 300 AND 999 THEN a END, CASE WHEN b BETWEEN 4000000000000000 AND 4999999999999999 THEN b END) AS v FROM
(SELECT doc_id, try_cast(regexp_extract(text, '\\(([0-9]{3})\\)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(text, '([0-9]{16})', 1) AS DOUBLE) AS b FROM documents)""")
def tx1_extract_number(spark, d):
    one = C.null_outside(F.regexp_extract("text", r"\(([0-9]{3})\)", 1).try_cast("double"), 300, 999)
    return docs(spark, d).select("doc_id", F.coalesce(one, C.extract_number(F.col("text"), ["([0-9]{16})"], 4e15, 4999999999999999)).alias("v"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '[a-z0-9.]+@[a-z0-9.]+', 0), ''), nullif(regexp_extract(text, '[0-9]{3}-[0-9]{4}', 0), '')) AS found FROM documents")
def tx2_extract_first(spark, d):
    return docs(spark, d).select("doc_id", C.extract_first(F.col("text"), ["[a-z0-9.]+@[a-z0-9.]+", "[0-9]{3}-[0-9]{4}"]).alias("found"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN l_discount WHEN l_linenumber % 3 = 1 AND l_discount * 100 BETWEEN 1 AND 100 THEN l_discount * 100 / 100 WHEN l_linenumber % 3 = 2 THEN l_tax END, 6) AS fraction FROM lineitem""")
def tx3_extract_cascade(spark, d):
    """Fraction from a formula, else a percentage, else 'x='; each within 0 to 1."""
    kind, disc = F.col("l_linenumber") % 3, F.col("l_discount")
    text = (F.when(kind == 0, F.concat(F.lit("A1B"), disc.cast("string"), F.lit("C")))
            .when(kind == 1, F.concat(F.round(disc * 100, 0).cast("int").cast("string"), F.lit(" % doped"))).otherwise(F.concat(F.lit("x = "), F.col("l_tax").cast("string"))))
    frac = C.extract_number(text, [r"A1B([0-9.]+)C"], 0, 1)
    percent = C.extract_number(text, [r"([0-9.]+) ?%"], 1, 100) / 100
    x = C.extract_number(text, [r"x ?= ?([0-9.]+)"], 0, 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.extract_cascade([frac, percent, x]), 6).alias("fraction"))


@query(f"SELECT doc_id, md5(array_to_string([x FOR x IN {_S} IF NOT regexp_matches(x, '[0-9]')], ' ')) AS kept FROM documents")
def tx4_drop_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.md5(C.drop_sentences(F.col("text"), "[0-9]")).alias("kept"))


@query(f"""WITH s AS ({_SENT}), n AS (SELECT *, string_agg(s, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM s),
k AS (SELECT *, regexp_extract(s, '([0-9]{{3,16}})', 1) AS v, CASE WHEN regexp_matches(near, 'example') THEN 'mail' WHEN regexp_matches(near, 'the|der|le') THEN 'plain' END AS kind FROM n WHERE NOT regexp_matches(near, 'AKIA'))
SELECT doc_id, kind, try_cast(arg_min(v, i) AS DOUBLE) AS value FROM k WHERE v <> '' AND kind IS NOT NULL GROUP BY 1, 2""")
def tx5_extract_in_context(spark, d):
    return X.extract_in_context(docs(spark, d), "doc_id", "text", "([0-9]{3,16})", [("mail", "example"), ("plain", "the|der|le")], "AKIA")


@query("SELECT l_orderkey, arg_min(CAST(l_quantity AS INTEGER), (l_linenumber, l_quantity)) FILTER (l_linenumber % 2 = 1)::DOUBLE AS proofed, arg_min(CAST(l_quantity AS INTEGER), (l_linenumber, l_quantity)) FILTER (l_linenumber % 2 = 0)::DOUBLE AS baked FROM lineitem GROUP BY 1")
def tx6_staged_of_all_lines(spark, d):
    """All lines of an order in one text, a clause each; the first clause of a stage counts."""
    q = F.col("l_quantity").cast("int")
    clause = F.concat(F.when(F.col("l_linenumber") % 2 == 1, "proofed at ").otherwise("baked at "), q.cast("string"), F.lit(" C"))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", clause.alias("c"))))
    text = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Dough was "), F.array_join(F.transform(parts, lambda x: x["c"]), " and then "), F.lit(".")).alias("t"))
    return X.extract_staged(text, "l_orderkey", "t", [("proofed", "proofed"), ("baked", "baked")], r"([0-9]+) C")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS merged FROM orders")
def tx7_overlay(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.overlay(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("merged"))


@query("""SELECT page_id, CASE WHEN instr(lower(html), '<body') > 0 THEN substring(html, instr(lower(html), '<body'), 120) WHEN instr(lower(html), '<p>') > 0 THEN substring(html, instr(lower(html), '<p>'), 120) ELSE substring(html, 1, 120) END AS snippet FROM pages""")
def tx8_section(spark, d):
    return table(spark, d, "pages").select("page_id", C.section(F.col("html"), ["<body", "<p>"], 120).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN substring(text, a, 90) || chr(10) || substring(text, b, 110) WHEN a > 0 THEN substring(text, a, 150) WHEN b > 0 THEN substring(text, b, 150) ELSE substring(text, 1, 200) END AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'license') AS a, instr(lower(text), 'example') AS b FROM documents)""")
def tx9_sections_budget(spark, d):
    return docs(spark, d).select("doc_id", C.sections_budget(F.col("text"), "license", "example", 200).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN a > 0 AND b > 0 THEN substring(text, a, 90) || chr(10) || substring(text, b, 110) WHEN a > 0 THEN substring(text, a, 120) || chr(10) || substring(text, length(text) - 79, 80) WHEN b > 0 THEN substring(text, 1, 80) || chr(10) || substring(text, b, 120)
ELSE substring(text, 1, 150) || chr(10) || substring(text, length(text) - 49, 50) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'license') AS a, instr(lower(text), 'example') AS b FROM documents)""")
def tx9_sections_with_ends(spark, d):
    """One section is joined by the text's other end, none by both."""
    return docs(spark, d).select("doc_id", C.sections_with_ends(F.col("text"), "license", "example", 200).alias("snippet"))


def rebuilt(texts):
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")
    # dealt by id while they are texts: both groupings find each id's words in one task, and no exploded word is shuffled
    texts = texts.select("doc_id", "text").repartition("doc_id")
    rows = texts.select("doc_id", F.posexplode_outer(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("w", F.lit("")), "ps"))).alias("m"))
    return index.select("doc_id", F.md5(C.reconstruct_text(F.col("m"))).alias("rebuilt"))


@query("SELECT doc_id, md5(array_to_string([x FOR x IN string_split_regex(lower(text), '[ \\t\\n\\r]+') IF x <> ''], ' ')) AS rebuilt FROM documents")
def tx10_reconstruct_whole_text(spark, d):
    """Built from the words' positions, as the inverted index of a record's abstract has them, and put together again."""
    return rebuilt(docs(spark, d))


@query("SELECT doc_id, CAST(generate_subscripts(m, 1) AS INTEGER) AS nth, unnest(m) AS matched, CAST(unnest(v) AS DOUBLE) AS value FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]{3})-[0-9]{4}', 0) AS m, regexp_extract_all(text, '([0-9]{3})-[0-9]{4}', 1) AS v FROM documents)")
def tx11_quantity_spans(spark, d):
    return X.quantity_spans(docs(spark, d), "doc_id", "text", "([0-9]{3})-[0-9]{4}")


@query("""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{3}-[0-9]{4}', 0) AS m, string_split_regex(text, '[0-9]{3}-[0-9]{4}') AS s FROM documents), e AS (SELECT doc_id, m, s, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS i FROM m)
SELECT doc_id, 'phone' AS type, CAST(substring(m[i], 1, 3) AS DOUBLE) AS value, substring(m[i], 5, 4) AS unit, CAST(list_sum([length(x) FOR x IN s[1:i]]) + 8 * (i - 1) AS INTEGER) AS start, m[i] AS raw FROM e""")
def tx11_typed_spans(spark, d):
    """Every match with its type, parts and place; the second type overlaps the first and gives way."""
    kinds = {"phone": "([0-9]{3})-([0-9]{4})", "tail": "-([0-9]{4})()"}
    found = X.typed_spans(docs(spark, d), "doc_id", "text", kinds)
    return found.where("type = 'phone' or substring(raw, 1, 1) <> '-'").select("doc_id", "type", "value", "unit", "start", "raw")


@query("SELECT p_partkey, 'Ce' AS left_name, 'Zr' AS right_name, CAST(p_size AS DOUBLE) AS left_part, CAST(p_size + 1 AS DOUBLE) AS right_part FROM part")
def tx12_ratio_spans(spark, d):
    text = F.concat(F.lit("with Ce:Zr = "), F.col("p_size"), F.lit(":"), F.col("p_size") + 1, F.lit(" by weight"))
    return X.ratio_spans(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t", r"([A-Za-z]+)[:/]([A-Za-z]+) ?= ?([0-9.]+):([0-9.]+)")


@query("""WITH m AS (SELECT page_id, regexp_extract_all(url, '([A-Za-z]+)/([A-Za-z]+)', 1) AS a, regexp_extract_all(url, '([A-Za-z]+)/([A-Za-z]+)', 2) AS b FROM pages), p AS (SELECT page_id, lower(unnest(a)) AS a, lower(unnest(b)) AS b FROM m)
SELECT page_id, a, b, (a IN ('com', 'en') AND b IN ('com', 'en')) AS both_known FROM p WHERE a || '/' || b NOT IN ('org/de', 'net/fr')""")
def tx13_slash_pairs(spark, d):
    words = spark.createDataFrame([("com",), ("en",)], "word string")
    return X.slash_pairs(table(spark, d, "pages"), "page_id", "url", words, ["org/de", "net/fr"])


_WORDS = "SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) AS INTEGER) AS nth FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM documents)"


@query(f"WITH w AS ({_WORDS}) SELECT doc_id, nth, word, name FROM w JOIN (SELECT 'license' AS word, 'legal' AS name UNION ALL SELECT 'licensed', 'legal' UNION ALL SELECT 'password', 'secret' UNION ALL SELECT 'token', 'secret') USING (word)")
def tx14_term_spans(spark, d):
    terms = spark.createDataFrame([("License", "legal"), ("Licensed", "legal"), ("password", "secret"), ("token", "secret")], "term string, name string")
    return X.term_spans(docs(spark, d), "doc_id", "text", terms)


_PHRASES = [("public license", "legal"), ("license", "permit"), ("all rights reserved", "claim"), ("rights", "claim"), ("token", "secret")]


@query(f"""WITH w AS ({_WORDS}), t AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY nth) AS w2, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY nth) AS w3, lag(word) OVER (PARTITION BY doc_id ORDER BY nth) AS w0 FROM w)
SELECT doc_id, nth, 3 AS n_words, 'claim' AS name FROM t WHERE word = 'all' AND w2 = 'rights' AND w3 = 'reserved' UNION ALL SELECT doc_id, nth, 2, 'legal' FROM t WHERE word = 'public' AND w2 = 'license'
UNION ALL SELECT doc_id, nth, 1, 'permit' FROM t WHERE word = 'license' AND w0 IS DISTINCT FROM 'public' UNION ALL SELECT doc_id, nth, 1, 'claim' FROM t WHERE word = 'rights' AND NOT (w0 IS NOT DISTINCT FROM 'all' AND w2 IS NOT DISTINCT FROM 'reserved') UNION ALL SELECT doc_id, nth, 1, 'secret' FROM t WHERE word = 'token'""")
def tx14_phrase_spans(spark, d):
    """Terms of several words; the longest at a place stands."""
    return X.phrase_spans(docs(spark, d), "doc_id", "text", spark.createDataFrame(_PHRASES, "term string, name string"))


@query("SELECT p_partkey, upper(substring(p_name, 1, 3)) AS abbreviation, 'fine ' || lower(regexp_extract(p_name, '^[a-zA-Z]+')) AS full, 'known' AS name, 2 AS uses FROM part WHERE length(regexp_extract(p_name, '^[a-zA-Z]+')) >= 3")
def tx15_abbreviation_uses(spark, d):
    """Defined once behind a two-word name of the dictionary, used once more; the dictionary holds the parts' own names."""
    parts = table(spark, d, "part").withColumns({"n": F.regexp_extract("p_name", "^[a-zA-Z]+", 0), "a": F.upper(F.substring("p_name", 1, 3))}).where("length(n) >= 3")
    text = F.concat(F.lit("We mixed fine "), "n", F.lit(" ("), "a", F.lit(") well. The "), "a", F.lit(" dried."))
    terms = parts.select(F.concat(F.lit("fine "), "n").alias("term"), F.lit("known").alias("name")).distinct()
    return X.abbreviation_uses(parts.select("p_partkey", text.alias("t")), "p_partkey", "t", terms=terms).withColumn("uses", F.col("uses").cast("int"))


@query("SELECT p_partkey, upper(substring(p_name, 1, 3)) AS abbreviation, regexp_extract(p_name, '^[a-zA-Z]+') AS full FROM part")
def tx15_abbreviation_defs(spark, d):
    name, short = F.regexp_extract("p_name", "^[a-zA-Z]+", 0), F.upper(F.substring("p_name", 1, 3))
    text = F.concat(F.lit("We use "), name, F.lit(" ("), short, F.lit(") and other ("), short, F.lit(")."))
    return X.abbreviation_defs(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


_BARE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""SELECT doc_id, 'source' AS field, source AS value FROM documents WHERE NOT (contains({_BARE.format('text')}, {_BARE.format('source')}) OR contains({_BARE.format('text')}, substring({_BARE.format('source')}, 1, 5)))
UNION ALL SELECT doc_id, 'topic', 'license; public' FROM documents WHERE doc_id % 3 = 0 AND NOT ((contains({_BARE.format('text')}, 'licen')) AND (contains({_BARE.format('text')}, 'publi')))""")
def tx16_audit_presence(spark, d):
    rows = docs(spark, d).withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "license; public"))
    return X.audit_presence(rows.select("doc_id", "source", "topic"), docs(spark, d), "doc_id", ["source", "topic"], "text", C.presence, C.bare_text)


@query("SELECT doc_id, regexp_matches(text, '(?is)(license).{0,60}(version)|(version).{0,60}(license)') AS near FROM documents")
def tx17_within_chars(spark, d):
    return docs(spark, d).select("doc_id", C.within_chars(F.col("text"), "license", "version", 60).alias("near"))


@query("""WITH b AS (SELECT doc_id, text, [x FOR x IN string_split(text, chr(10)) IF length(x) >= 80 AND regexp_matches(x, 'the|der|le|que')] AS g FROM documents), f AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN g ELSE [text] END AS g FROM b)
SELECT doc_id, doc_id || '_EXP' || lpad(CAST(generate_subscripts(g, 1) AS VARCHAR), CAST(greatest(3, length(CAST(generate_subscripts(g, 1) AS VARCHAR))) AS INTEGER), '0') AS block_id, md5(unnest(g)) AS block FROM f""")
def tx18_explode_blocks(spark, d):
    return X.explode_blocks(docs(spark, d), "doc_id", "text", 80, "the|der|le|que").withColumn("block", F.md5("block"))


@query("SELECT l_orderkey, string_agg(l_returnflag, '; ' ORDER BY o, l_returnflag) AS summary FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def tx19_summarize(spark, d):
    return X.summarize(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


@query("SELECT p_partkey, p_size || ' g' AS quantity, p_type AS name, 0.95 AS score FROM (SELECT p_partkey, p_size, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS p_type FROM part)")
def tx20_direct_links(spark, d):
    name = F.regexp_replace(F.lower("p_type"), "[^a-z]", "")
    text = F.concat(F.lit("Then "), F.col("p_size"), F.lit(" g of "), name, F.lit(" was added."))
    links = X.direct_links(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t", {"of": (r"([0-9]+ g) of ([a-z]+)", 0.95), "loose": (r"([0-9]+ g) of ([a-z])", 0.9)})
    return links.select("p_partkey", "quantity", "name", F.col("score").cast("decimal(3,2)").alias("score"))


_SIX = (("quantity_of_name", "mass", 1, "g"), ("quantity_then_name", "volume", 2, "mL"), ("name_parenthesis_quantity", "mass", 3, "mg"), ("concentration_name_solution", "concentration", 4, "M"),
        ("solution_of_concentration_name", "concentration", 5, "mM"), ("name_solution_of_concentration", "concentration", 6, "M"))


@query(" UNION ALL ".join(f"SELECT p_partkey, p_type AS name, '{kind}' AS type, CAST(p_size + {i} AS DOUBLE) AS value, '{unit}' AS unit, '{form}' AS form, CAST({0.9 if form == 'quantity_then_name' else 0.95} AS DOUBLE) AS score FROM part" for form, kind, i, unit in _SIX))
def tx20_links_of_six_forms(spark, d):
    """A text with all forms for each part; names come from a table of two-word terms, one of which begins with another."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    kinds = part.select("p_type").distinct()
    terms = kinds.select(F.concat(F.lower("p_type"), F.lit(" flakes")).alias("term"), F.col("p_type").alias("name")).unionByName(kinds.select(F.lower("p_type").alias("term"), F.lit("bare").alias("name")))
    n, q = F.concat(F.initcap("p_type"), F.lit(" Flakes")), lambda i: (F.col("p_size") + i).cast("string")
    text = F.concat(F.lit("We took "), q(1), F.lit(" g of the dried "), n, F.lit(". Then "), q(2), F.lit("mL "), n, F.lit(" was added. "), n, F.lit(" ("), q(3), F.lit(" mg) came next. A "), q(4), F.lit(" M "), n,
                    F.lit(" solution stood; a solution of "), q(5), F.lit(" mM "), n, F.lit(" is kept. At last "), n, F.lit(" solution of "), q(6), F.lit(" M."))
    return X.symbol_links(part.select("p_partkey", text.alias("t")), "p_partkey", "t", terms)


_TERM = f"WITH w AS ({_WORDS}), q AS (SELECT doc_id, nth AS qpos FROM w WHERE word = 'mail'), t AS (SELECT doc_id, nth AS tpos, word FROM w WHERE word IN ('example', 'license', 'com'))"


@query(f"""{_TERM}, j AS (SELECT q.doc_id, qpos, tpos, word, abs(qpos - tpos) AS distance, row_number() OVER (PARTITION BY q.doc_id, qpos ORDER BY abs(qpos - tpos), tpos, word) AS r FROM q JOIN t ON q.doc_id = t.doc_id AND abs(qpos - tpos) <= 20)
SELECT doc_id, qpos, word, CAST(distance AS INTEGER) AS distance FROM j WHERE r = 1""")
def jn11_nearest_link(spark, d):
    words = X.word_spans(docs(spark, d), "doc_id", "text")
    q = words.where("word = 'mail'").select("doc_id", F.col("nth").alias("qpos"))
    t = words.where("word in ('example', 'license', 'com')").select("doc_id", F.col("nth").alias("tpos"), "word")
    return X.nearest_link(q, t, "doc_id", "qpos", "tpos", "word", 20)


@query("""SELECT p_partkey, 'mass' AS type, CAST(p_size AS DOUBLE) AS value, n AS name, 'value first' AS direction, 4 AS distance, round(1.0 - 4 / 160.0 * 0.45 + 0.18 + 0.08, 4) AS score FROM (SELECT p_partkey, p_size, lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS n FROM part)
UNION ALL SELECT p_partkey, 'concentration', CAST(p_size AS DOUBLE), n, 'value first', 2, round(1.0 - 2 / 160.0 * 0.45 + 0.18 + 0.06, 4) FROM (SELECT p_partkey, p_size, lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS n FROM part)""")
def jn11_scored_links(spark, d):
    """Two quantities and two places of a name in a text for each part; direction, distance and the words between decide."""
    n = F.lower(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    q = F.col("p_size").cast("string")
    text = F.concat(F.lit("We took "), q, F.lit(" g of "), n, F.lit(" and then water. Later "), q, F.lit(" M ("), n, F.lit(" solution) was added; after that nothing."))
    parts = table(spark, d, "part").select("p_partkey", text.alias("t"), n.alias("n"))
    spans = X.typed_spans(parts, "p_partkey", "t", {"mass": r"([0-9]+) (g)\b", "concentration": r"([0-9]+) (M)\b"})
    word = F.explode(F.transform(X.spans(F.col("t"), r"\b[a-z]+\b"), lambda x: x))
    names = parts.select("p_partkey", "n", word.alias("x")).where("x.matched = n").select("p_partkey", F.col("n").alias("name"), F.lit("additive").alias("category"), "x.start", "x.stop")
    found = X.scored_links(spans, names, parts, "p_partkey", "t", classes=["additive"])
    return found.select("p_partkey", "type", "value", "name", "direction", "distance", "score")


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, 0.9 AS score FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_returnflag, 0.5 FROM lineitem) SELECT l_orderkey, l_returnflag, CAST(max(score) AS DOUBLE) AS score FROM a GROUP BY 1, 2""")
def jn12_merge_links(spark, d):
    lines = table(spark, d, "lineitem")
    a = lines.where("l_linenumber = 1").select("l_orderkey", "l_returnflag", F.lit(0.9).cast("double").alias("score"))
    return X.merge_links(a, lines.select("l_orderkey", "l_returnflag", F.lit(0.5).cast("double").alias("score")), ["l_orderkey", "l_returnflag"])
