"""Cases that the tables of the oracle tests don't hold: odd values, repeated keys, several files and batches."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from graintable.functions import columns as C
from graintable.functions import sql
from graintable.operators import aggregates as A
from graintable.operators import extract as X
from graintable.operators import modelling as M
from graintable.operators import relational as R
from graintable.operators import reshape
from graintable.operators.dedup import dedup_two_keys
from graintable.operators.quantiles import quantiles
from graintable.sources import files as S
from graintable.streaming import incremental as I


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_canonical_scalar_drops_what_is_no_value(spark):
    texts = ["nan", "NaN", "None", " inf ", "-Infinity", "", "  ", None, "5.0", "1.23456", " as is "]
    got = [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.canonical_scalar(F.col("t"))).collect()]
    assert got == [None] * 8 + ["5", "1.2346", "as is"]
    assert frame(spark, [(float("nan"),), (2.0,)], "x double").select(C.canonical_scalar(F.col("x")).alias("v")).collect()[0].v is None


def test_entities_of_all_kinds(spark):
    text = "a&nbsp;b &amp;lt; &eacute;&#233;&#xE9; &notanentity; &#x1F600; 5 & 6 &amp"
    assert frame(spark, [(text,)], "t string").select(C.clean_html(F.col("t")).alias("v")).first().v == "a b &lt; ééé &notanentity; 😀 5 & 6 &amp"


def test_quantiles_of_groups_and_ties(spark):
    rows = [("a", float(x)) for x in (5, 1, 1, 3, 9, 2)] + [("b", 4.0), (None, 7.0), (None, 8.0), ("b", None)]
    got = {r.g: list(r.q) for r in quantiles(frame(spark, rows, "g string, x double"), "x", [0.0, 0.25, 0.5, 1.0], ["g"]).collect()}
    q = statistics.quantiles([5, 1, 1, 3, 9, 2], n=4, method="inclusive")
    assert got == {"a": [1.0, q[0], q[1], 9.0], "b": [4.0] * 4, None: [7.0, 7.25, 7.5, 8.0]}
    assert quantiles(frame(spark, [], "x double"), "x", [0.5]).collect()[0].q == [None]


def test_patch_with_repeated_keys_keeps_the_rows(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    patch = frame(spark, [(1, "x", 1), (1, None, 3), (1, "y", 2), (2, "z", 1)], "k int, v string, at int")
    got = sorted((r.k, r.v, r.changed_) for r in R.apply_patch(df, patch, "k", ["v"], order="at").collect())
    assert got == [(1, "y", True), (2, "z", True), (2, "z", True)]


def test_joins_never_multiply_rows(spark):
    base = frame(spark, [(1, "other"), (2, "known")], "k int, v string")
    cache = frame(spark, [(1, "c1"), (1, "c2")], "k int, value string")
    texts = frame(spark, [(1, "t"), (1, "u")], "k int, text string")
    tags = frame(spark, [(1, "g"), (1, "h")], "k int, tag string")
    got = R.recover(base, "k", "v", cache, texts, tags, F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert sorted(map(tuple, got.collect())) == [(1, "c2"), (2, "known")]
    common = R.recover(base, "k", "v", cache.limit(0), texts, tags, F.lit(None).cast("string"), F.lit("vague"), common=["vague"])
    assert sorted(map(tuple, common.collect())) == [(1, "h"), (2, "known")]
    vocabulary = frame(spark, [("other", 4), ("other", 3)], "value string, code int")
    assert sorted(r.c for r in R.encode(base, "v", vocabulary, "c", 9).collect()) == [3, 9]


def test_upsert_takes_the_first_of_several_new_rows(spark):
    old = frame(spark, [(1, 0)], "k int, v int")
    new = frame(spark, [(1, 5), (1, 7), (2, 1)], "k int, v int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], [F.col("v").desc()]).collect())) == [(1, 7), (2, 1)]


def test_junk_never_claims_a_key(spark):
    rows = [(1, "same title", "junk"), (2, "same title", "good"), (3, "", "good")]
    df = frame(spark, rows, "k int, t string, c string")
    assert sorted(r.k for r in dedup_two_keys(df, "k", "t", ["k"], F.col("c") == "junk").collect()) == [2, 3]


def test_headers_in_several_files(spark, tmp_path):
    for i, lines in enumerate((["note", "a,key", "1,x"], ["key, a", "y,2"][:0] + ["a,key", "2,\"y, z\"", "a,key"], ["", "more", "\"a\",\"key\"", "3,w"])):
        (tmp_path / f"{i}.csv").write_text("\n".join(lines) + "\n")
    got = S.read_with_header_probe(spark, str(tmp_path), "key")
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y, z"), ("3", "w"), ("a", "key")]
    (tmp_path / "9.csv").write_text("no header\n")
    with pytest.raises(ValueError):
        S.read_with_header_probe(spark, str(tmp_path), "key")


def test_versions_switch_by_number(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i in range(4):
        S.overwrite_atomic(spark.range(i), path)
        assert S.current(spark, path).count() == i


def test_batches_go_on_from_each_other(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.overwrite_atomic(frame(spark, [("a", 1), ("b", 2)], "key string, id long"), path)
    I.merge_arrivals(spark, [frame(spark, rows, "key string") for rows in ([("d",), ("b",), ("c",)], [], [("d",), ("e",)])], path, "key", "id", "key")
    assert sorted(map(tuple, S.current(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


def test_equal_left_rows_are_all_linked(spark):
    left = frame(spark, [(1, 5), (1, 5), (1, 50)], "k int, p int")
    right = frame(spark, [(1, 7, "x"), (1, 3, "y")], "k int, q int, n string")
    assert sorted(map(tuple, X.nearest_link(left, right, "k", "p", "q", "n", 10).collect())) == [(1, 5, "y", 2), (1, 5, "y", 2)]


def test_merged_links_keep_their_columns(spark):
    a = frame(spark, [(1, "n", 0.5, "far")], "k int, name string, score double, how string")
    b = frame(spark, [(1, "n", 0.9, "of"), (2, "m", 0.4, "of")], "k int, name string, score double, how string")
    assert sorted(map(tuple, X.merge_links(a, b, ["k", "name"]).collect())) == [(1, "n", 0.9, "of"), (2, "m", 0.4, "of")]


def test_spans_stand_where_they_match(spark):
    text = "15 g here, 5 g there \x01 5 g"
    got = X.typed_spans(frame(spark, [(1, text), (2, None), (3, "")], "k int, t string"), "k", "t", {"mass": r"\\b([0-9]+) (g)\\b".replace("\\\\", "\\")})
    rows = sorted((r.k, r.start, r.stop, r.value, r.unit) for r in got.collect())
    assert [(k, v, u) for k, _, _, v, u in rows] == [(1, 15.0, "g"), (1, 5.0, "g"), (1, 5.0, "g")]
    assert all(text[a:b] == f"{int(v)} g" for _, a, b, v, _ in rows)


def test_normal_cdf(spark):
    zs = [-6.0, -1.5, -0.1, 0.0, 0.7, 3.0]
    got = [r[0] for r in frame(spark, [(i, z) for i, z in enumerate(zs)], "i int, z double").orderBy("i").select(M.normal_cdf(F.col("z"))).collect()]
    assert all(abs(g - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7 for g, z in zip(got, zs, strict=True))


def test_noise_ceiling_with_a_least_count_a_level(spark):
    rows = [(1, 10.0), (1, 12.0), (2, 30.0), (2, 31.0), (2, 29.0)]
    both = A.noise_ceiling(frame(spark, rows, "g int, y double"), "y", [["g"], ["g"]], [2, 3]).collect()
    assert sorted(r.groups for r in both) == [1, 2]


def test_aliases_count_as_present(spark):
    df = frame(spark, [("cetyl bromide (CTAB) was used", "surfactant x")], "t string, v string")
    bare = C.bare_text(F.col("t"))
    assert df.select(C.presence(bare, F.col("v")).alias("a"), C.presence(bare, F.col("v"), aliases={"Surfactant X": ["CTAB"]}).alias("b")).first() == (False, True)


def test_sql_functions_equal_the_builders(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) == len(sql.FUNCTIONS) + len(sql.TABLE_FUNCTIONS)
    rows = [(" 5.5 ", 2.0, 4.0, True), ("nan", None, 0.0, False), ("N/A", 9.0, None, None), ("", -1.0, 2.0, True), (None, 3.0, 1.0, False), ("https://doi.org/10.1/X; b", 0.5, 0.5, True)]
    df = frame(spark, rows, "s string, x double, y double, f boolean")
    df.createOrReplaceTempView("odd_values")
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    pairs = {
        "grain_to_number(s)": C.to_number(s), "grain_null_outside(x, 1, 5)": C.null_outside(x, 1, 5), "grain_clean_null(s, array('n/a'))": C.clean_null(s, ["N/A"]),
        "grain_normalize_key(s, 'https://doi.org/')": C.normalize_key(s, ["https://doi.org/"]), "grain_first_token(s)": C.first_token(s), "grain_bare_text(s)": C.bare_text(s),
        "grain_safe_ratio(x, y, 0.1, 9)": C.safe_ratio(x, y, 0.1, 9), "grain_log_clip(x, 1)": C.log_clip(x), "grain_null_if_inconsistent(x, y, 2)": C.null_if_inconsistent(x, y, 2),
        "grain_norm_categorical(s)": C.norm_categorical(s), "grain_resolve_range(x, f, 1, y)": C.resolve_range(x, F.col("f"), F.lit(1.0), y), "grain_within_chars(s, 'doi', 'x', 9)": C.within_chars(s, "doi", "x", 9),
        "grain_closeness(y, 2, 0.3)": M.closeness(y, 2.0),
    }
    assert len(pairs) == len(sql.FUNCTIONS)
    for text, builder in pairs.items():
        a = [r[0] for r in spark.sql(f"SELECT {text} FROM odd_values").collect()]
        assert a == [r[0] for r in df.select(builder).collect()], text


def test_names_are_put_together_from_what_was_found(spark):
    entries = [("A", "oak board", [r"oak (?:board|beam)s?", "quercus"]), ("B", "pine board", [r"pine (?:board|beam)s?"])]
    df = frame(spark, [(1, "Oak beams on pine boards"), (2, "quercus"), (3, None), (4, "oaken")], "k int, t string")
    got = {r.k: (r.labels, r.names) for r in reshape.extract_named(df, "t", entries, "(board|beam)").collect()}
    assert got == {1: (["A", "B"], ["oak beam", "pine board"]), 2: (["A"], ["oak board"]), 3: ([], []), 4: ([], [])}


def test_sql_table_functions_equal_the_operators(spark):
    sql.register(spark)
    texts = ["One 5 g. Two 7.5 g! Three", "short\na longer line with oak 3 g\nanother long line, no", "", None, "OAK\nPine 12 g"]
    df = frame(spark, list(enumerate(texts)), "k int, t string")
    df.createOrReplaceTempView("odd_texts")
    same = lambda query, other: sorted(map(str, (tuple(r) for r in spark.sql(query).collect()))) == sorted(map(str, (tuple(r) for r in other.collect())))
    number = r"([0-9]+(?:[.][0-9]+)?) g"
    assert same("SELECT k, f.pos, f.sentence FROM odd_texts, LATERAL grain_sentences(t) f", X.sentences(df, "k", "t"))
    assert same(f"SELECT k, f.nth, f.matched, f.value FROM odd_texts, LATERAL grain_spans(t, '{number}') f", X.quantity_spans(df, "k", "t", number))
    assert same("SELECT k, f.nth, f.word FROM odd_texts, LATERAL grain_words(t) f", X.word_spans(df, "k", "t"))
    blocks = X.explode_blocks(df, "k", "t", 10, "line").select("k", F.substring_index("block_id", "EXP", -1).cast("int").alias("nth"), "block")
    assert same("SELECT k, f.nth, f.block FROM odd_texts, LATERAL grain_blocks(t, 10, 'line') f", blocks)
    tags = df.select("k", F.explode(C.tag_keywords(F.col("t"), [("wood", ["oak", "pine"]), ("mass", [" g"])])).alias("tag"))
    assert same("SELECT k, f.tag FROM odd_texts, LATERAL grain_tags(t, map('wood', array('oak', 'pine'), 'mass', array(' g'))) f", tags)
    assert "Python" not in spark.sql("SELECT k, f.word FROM odd_texts, LATERAL grain_words(t) f")._jdf.queryExecution().toString()
