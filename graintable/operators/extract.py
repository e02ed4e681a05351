"""Operators that turn texts into rows of values, spans, terms, ratios, blocks and links."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.operators.intervals import overlaps
from graintable.sources.files import materialize

SENTENCE = r"(?<=[.!?])\s+"


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, pos (from 0), sentence; nulls have none."""
    return df.select(id_col, F.posexplode(F.split(text_col, SENTENCE)).alias("pos", "sentence"))


def extract_in_context(df: DataFrame, id_col: str, text_col: str, value: str, contexts: Sequence[tuple[str, str]], exclude: str | None = None,
                       lookback: int = 2) -> DataFrame:
    """id_col, kind, value: the first number of each kind.

    A sentence's first value (group 1 of the pattern) gets the first kind whose pattern is found in that
    sentence or the `lookback` before it; sentences whose context matches exclude give none.
    """
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(-lookback, 0)
    around = sentences(df, id_col, text_col).withColumn("near", F.concat_ws(" ", F.collect_list("sentence").over(w)))
    kind: Column | None = None
    for name, pattern in contexts:
        hit = F.col("near").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    found = around.withColumn("value", F.regexp_extract("sentence", value, 1)).where("value <> ''").withColumn("kind", kind).where("kind is not null")
    if exclude:
        found = found.where(~F.col("near").rlike(exclude))
    return found.groupBy(id_col, "kind").agg(F.min_by("value", "pos").try_cast("double").alias("value"))


def extract_staged(df: DataFrame, id_col: str, text_col: str, stages: Sequence[tuple[str, str]], number: str, split: str = r"\s+and then\s+|\s+then\s+|;") -> DataFrame:
    """id_col and one column a stage: the first number of the first clause (of all sentences) that names the stage."""
    clauses = (sentences(df, id_col, text_col)
               .select(id_col, "pos", F.posexplode(F.split("sentence", split)).alias("part", "clause"))
               .withColumn("value", F.nullif(F.regexp_extract("clause", number, 1), F.lit(""))).where("value is not null"))
    order = F.struct("pos", "part")
    hits = [F.min_by(F.when(F.col("clause").rlike(p), F.col("value")), F.when(F.col("clause").rlike(p), order)).try_cast("double").alias(name) for name, p in stages]
    return clauses.groupBy(id_col).agg(*hits)


def quantity_spans(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id_col, nth (from 1), matched, value: every match of a pattern whose first group is the number."""
    both = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("v"))
    return df.select(id_col, F.posexplode(both).alias("nth", "x")).select(id_col, (F.col("nth") + 1).alias("nth"), F.col("x.m").alias("matched"), F.col("x.v").try_cast("double").alias("value"))


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, stop, matched) of a pattern's matches, positions from 0.

    Matches are marked in place by two control characters (those of the text count as spaces) and cut there, so positions are those of the matches themselves.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "  "), pattern, "\x01$0\x02")

    def placed(parts: Column) -> Column:
        cells = F.zip_with(parts, running_sums(F.transform(parts, lambda x: F.length(x))), lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("stop"), x.alias("matched")))
        return F.filter(cells, lambda x, i: i % 2 == 1)

    return F.transform(F.array(F.split(marked, "[\x01\x02]")), placed)[0]  # in a lambda, so that a text is split once


def running_sums(numbers: Column) -> Column:
    """The sums of an array's members up to each, in stretches of the root of its length, so that a long array isn't copied for each of its members."""
    none = F.expr("cast(array() as array<int>)")

    def grown(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)

    def whole(a: Column) -> Column:
        w = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        inner = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), w), lambda i: F.aggregate(F.slice(a, i + 1, w), none, grown))
        before = lambda sums: F.aggregate(F.transform(sums, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))), F.array(F.lit(0)), grown)
        return F.transform(F.array(inner(w)), lambda sums: F.flatten(F.zip_with(sums, F.slice(before(sums), 1, F.size(sums)), lambda s, o: F.transform(s, lambda x: x + o))))[0]

    return F.transform(F.array(numbers), whole)[0]


def typed_spans(df: DataFrame, id_col: str, text_col: str, kinds: Mapping[str, str]) -> DataFrame:
    """id_col, type, value, unit, start, stop, raw of every quantity; kinds: type to a pattern whose groups 1 and 2 are number and unit.

    Where matches of several types overlap, the type named first keeps the place. Nulls have no spans; positions count from 0.
    """
    def of(rank: int, kind: str, pattern: str) -> Column:
        return F.transform(spans(F.col(text_col), pattern), lambda x: F.struct(
            F.lit(rank).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("type"), x["matched"].alias("raw"),
            F.regexp_extract(x["matched"], pattern, 1).try_cast("double").alias("value"), F.regexp_extract(x["matched"], pattern, 2).alias("unit")))

    found = F.flatten(F.array(*[of(i, k, p) for i, (k, p) in enumerate(kinds.items())]))
    rows = df.select(id_col, text_col, F.monotonically_increasing_id().alias("_row")).select(id_col, "_row", F.explode(found).alias("x")).select(id_col, "_row", "x.*")
    if len(kinds) > 1:
        # matches of a type don't overlap one another: of each earlier type only the last to start before and the next to start count
        # (a frame that begins at the row and ends with the partition would be gone through for each row, so the line is taken backwards for it)
        line, back = Window.partitionBy("_row").orderBy("start", "rank"), Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("rank"))
        behind, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (line, back))
        taken = F.lit(False)
        for k in range(len(kinds) - 1):
            own = lambda c: F.when(F.col("rank") == k, F.col(c))  # noqa: E731, B023
            hit = F.coalesce(F.max(own("stop")).over(behind) > F.col("start"), F.lit(False)) | F.coalesce(F.min(own("start")).over(ahead) < F.col("stop"), F.lit(False))
            taken = taken | ((F.col("rank") > k) & hit)
        rows = rows.withColumn("_taken", taken).where(~F.col("_taken"))
    return rows.select(id_col, "type", "value", "unit", "start", "stop", "raw")


def ratio_spans(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id_col, left_name, right_name, left_part, right_part of every match of a pattern with these four groups."""
    groups = [F.regexp_extract_all(text_col, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, 5)]
    return df.select(id_col, F.explode(F.arrays_zip(*groups)).alias("x")).select(
        id_col, F.col("x.g1").alias("left_name"), F.col("x.g2").alias("right_name"), F.col("x.g3").try_cast("double").alias("left_part"), F.col("x.g4").try_cast("double").alias("right_part"))


def slash_pairs(df: DataFrame, id_col: str, text_col: str, words: DataFrame, units: Sequence[str], pattern: str = r"([A-Za-z]+)/([A-Za-z]+)") -> DataFrame:
    """id_col, a, b, both_known: pairs a/b that aren't units; both_known where both are in words(word)."""
    zipped = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("b"))
    pairs = df.select(id_col, F.explode(zipped).alias("x")).select(id_col, F.lower("x.a").alias("a"), F.lower("x.b").alias("b"))
    pairs = pairs.where(~F.concat_ws("/", "a", "b").isin(list(units)))
    known = words.select(F.lower("word").alias("word")).distinct()
    return (pairs.join(known.select(F.col("word").alias("a"), F.lit(True).alias("ka")), "a", "left").join(known.select(F.col("word").alias("b"), F.lit(True).alias("kb")), "b", "left")
            .select(id_col, "a", "b", (F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("both_known")))


def word_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, nth, word: the letter runs of a text in lower case, in order from 1."""
    return df.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))).alias("p", "word")).select(id_col, (F.col("p") + 1).alias("nth"), "word")


def term_spans(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """id_col, nth, word, name: words that are terms(term, name); an equi-join on the word, so the dictionary may be of any size."""
    return word_spans(df, id_col, text_col).join(terms.select(F.lower("term").alias("word"), "name"), "word").select(id_col, "nth", "word", "name")


def phrase_spans(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, most_words: int = 4, part_rows: int = 500_000) -> DataFrame:
    """id_col, nth, n_words, name: terms(term, name) of up to most_words words, the longest at a place first, none over another.

    Runs of words are equi-joined to the terms where they are cut: terms are broadcast in parts of part_rows at most, one part in a pass over the texts,
    so the dictionary may be of any size and only hits are shuffled. Of a text's hits, longer ones and then earlier ones stand.
    A term with several names gives its least. Ids are those of single texts.
    """
    known = terms.select(F.array_join(F.regexp_extract_all(F.lower("term"), F.lit("[a-z]+"), F.lit(0)), " ").alias("phrase"), "name").where("phrase <> ''").groupBy("phrase").agg(F.min("name").alias("name"))
    known = materialize(known.withColumn("size", F.size(F.split("phrase", " "))).where(F.col("size") <= most_words), "phrases")
    stats = known.agg(F.count("*").alias("n"), F.max("size").alias("most")).first()
    words = F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))
    runs = (df.select(id_col, words.alias("w")).where(F.size("w") > 0).select(id_col, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("nth"))
            .select(id_col, "nth", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(stats["most"] or 1), F.size("w") - F.col("nth") + 1))).alias("n_words"))
            .select(id_col, "nth", "n_words", F.array_join(F.slice("w", F.col("nth"), F.col("n_words")), " ").alias("phrase")))
    parts = max(math.ceil(stats["n"] / part_rows), 1)
    found = None
    for i in range(parts):
        some = (known if parts == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)).select("phrase", "name")
        # the side is named, as the size of exploded rows isn't estimated: they would be taken for the smaller side
        hit = runs.join(F.broadcast(some), "phrase").select(id_col, "nth", "n_words", "name")
        found = hit if found is None else found.unionByName(hit)
    hits = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_words")).alias("o"), "nth", "n_words", "name"))).alias("hits"))
    kept = F.aggregate("hits", F.expr("cast(array() as array<struct<o:int,nth:int,n_words:int,name:string>>)"), lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["nth"] < x["nth"] + x["n_words"]) & (x["nth"] < y["nth"] + y["n_words"])), acc).otherwise(F.array_append(acc, x)))
    return hits.select(id_col, F.explode(kept).alias("x")).select(id_col, "x.nth", "x.n_words", "x.name")


def abbreviation_defs(df: DataFrame, id_col: str, text_col: str, pattern: str = r"([A-Za-z]+) \(([A-Z]{2,6})\)") -> DataFrame:
    """id_col, abbreviation, full: the first definition 'full name (ABC)' of each abbreviation in a document."""
    zipped = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("a"))
    rows = df.select(id_col, F.posexplode(zipped).alias("pos", "x"))
    return rows.groupBy(id_col, F.col("x.a").alias("abbreviation")).agg(F.min_by("x.n", "pos").alias("full"))


def abbreviation_uses(df: DataFrame, id_col: str, text_col: str, pattern: str = r"((?:[A-Za-z]+ ){0,3}[A-Za-z]+) \(([A-Z]{2,6})\)", terms: DataFrame | None = None) -> DataFrame:
    """id_col, abbreviation, full, name, uses: each text's defined abbreviations with how often they stand as words of the text.

    The full name is the longest tail of up to four words before the brackets that is a term of terms(term, name); without terms, the pattern's whole group. Ids are those of single texts.
    """
    zipped = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("a"))
    rows = df.select(id_col, F.posexplode(zipped).alias("pos", "x")).select(id_col, "pos", F.col("x.a").alias("abbreviation"), F.lower("x.n").alias("full"))
    if terms is not None:
        words = F.split("full", " ")
        tails = rows.select(id_col, "pos", "abbreviation", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, -k, k), " "))).alias("full"))
        rows = tails.join(terms.select(F.lower("term").alias("full"), "name").groupBy("full").agg(F.min("name").alias("name")), "full")
    else:
        rows = rows.withColumn("name", F.col("full"))
    first = rows.groupBy(id_col, "abbreviation").agg(F.min_by(F.struct("full", "name"), F.struct("pos", -F.length("full"))).alias("x")).select(id_col, "abbreviation", "x.full", "x.name")
    words = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0))).alias("abbreviation")).groupBy(id_col, "abbreviation").agg(F.count("*").alias("uses"))
    return first.join(words, [id_col, "abbreviation"], "left").select(id_col, "abbreviation", "full", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


def explode_blocks(df: DataFrame, id_col: str, text_col: str, least: int, must: str, split: str = r"\n") -> DataFrame:
    """id_col, block_id, block: parts of at least `least` characters in which `must` is found, numbered; the whole text if there is none."""
    good = F.filter(F.split(text_col, split), lambda x: (F.length(x) >= least) & x.rlike(must))
    blocks = F.when(F.size(good) > 0, good).otherwise(F.array(F.col(text_col)))
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(blocks).alias("p", "block")).select(
        id_col, F.format_string("%s_EXP%03d", F.col(id_col).cast("string"), F.col("p") + 1).alias("block_id"), "block")


def summarize(df: DataFrame, by: str, value: str, order: str, sep: str = "; ") -> DataFrame:
    """by, summary: the distinct values of a key in the order of their first rows, joined."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("_v")))), lambda x: x["_v"].cast("string")), sep).alias("summary"))


def audit_presence(values: DataFrame, texts: DataFrame, key: str, fields: Sequence[str], text_col: str, check, prepare=None) -> DataFrame:
    """key, field, value of each filled field whose value isn't in the key's text, by check(text, value).

    All fields of a key are checked in one row, against prepare(text) if given, which is worked out once a row.
    """
    shown = texts.select(key, (prepare(F.col(text_col)) if prepare else F.col(text_col)).alias("_text"))
    cells = values.select(key, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]).alias("_cells")).join(shown, key)
    bad = F.filter("_cells", lambda x: x["value"].isNotNull() & ~check(F.col("_text"), x["value"]))
    return cells.select(key, F.explode(bad).alias("x")).select(key, "x.field", "x.value")


def nearest_link(left: DataFrame, right: DataFrame, on: str, left_pos: str, right_pos: str, right_id: str, most: int) -> DataFrame:
    """Each left row with its closest right row of the same key within `most` positions; ties to the smaller right position, then id.

    An equi-join on the key and the position's bucket of width `most` (three of them), so no cartesian product arises. Equal left rows are
    linked once and come back as often as they were.
    """
    once = left.groupBy(*left.columns).agg(F.count("*").alias("_times"))
    a = once.withColumn("_b", F.explode(F.array(*[F.floor(F.col(left_pos) / most) + i for i in (-1, 0, 1)])))
    b = right.withColumn("_b", F.floor(F.col(right_pos) / most)).select(on, "_b", right_pos, right_id)
    joined = a.join(b, [on, "_b"]).withColumn("distance", F.abs(F.col(left_pos) - F.col(right_pos))).where(F.col("distance") <= most)
    best = joined.groupBy(*left.columns, "_times").agg(F.min(F.struct("distance", right_pos, right_id)).alias("_x"))
    return best.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*left.columns, F.col(f"_x.{right_id}").alias(right_id), "_x.distance")


# Fixed values of the link score: the greatest distance, what distance takes at most, what direction, punctuation, joining words,
# "of", brackets, a solution and a fitting class add or take, and the least score of a link.
LINK_DISTANCE = 160
LINK_FAR = 0.45
LINK_VALUE_FIRST, LINK_NAME_FIRST = 0.18, 0.10
LINK_STOP, LINK_JOIN, LINK_OF, LINK_BRACKETS = -0.35, -0.12, 0.08, 0.12
LINK_CLASS, LINK_SOLUTION = 0.06, 0.08
LINK_LEAST = 0.45
LINK_STOPS, LINK_JOINS, LINK_OFS, LINK_SOLUTIONS = r"[.;]", r"\b(and|or|then|after|before|while|which|that|with)\b", r"\bof\b", r"(?i)\bsolution\b"


def scored_links(quantities: DataFrame, names: DataFrame, texts: DataFrame, id_col: str, text_col: str, dissolved: Sequence[str] = ("concentration",), classes: Sequence[str] = ()) -> DataFrame:
    """quantities' columns, name, category, direction, distance, score: each quantity span with the name span of its text that scores best, if that is enough.

    quantities(id_col, type, start, stop, ...) and names(id_col, name, category, start, stop) are spans with positions from 0; texts(id_col, text_col) has one text an id.
    A score falls with the distance, with stops and joining words between, and rises with "of", brackets and, for `dissolved` types,
    with a category among classes and the word solution. Ties go to the name that starts closest behind the value, then to the first. What stands in and around a
    span is cut from its text once; spans then meet by id and place, each in bins of its own size, so a long one widens no other's.
    """
    reach = F.lit(LINK_DISTANCE)
    once = quantities.distinct()

    def cut(spans: DataFrame, around: bool) -> DataFrame:
        """With own, the span's text, and what stands up to the greatest distance before and after it."""
        t, start, stop = F.col("_text"), F.col("start"), F.col("stop")
        sides = {"_before": F.substring(t, F.greatest(start - reach, F.lit(0)) + 1, F.least(reach, start)), "_after": F.substring(t, stop + 1, reach)} if around else {}
        return spans.join(texts.select(id_col, F.col(text_col).alias("_text")), id_col).select(*spans.columns, F.substring(t, start + 1, stop - start).alias("_own"), *[c.alias(n) for n, c in sides.items()])

    # written, as the join looks at the spans' lengths first and reads them again for each size
    q = materialize(cut(once, True).withColumns({"_from": F.col("start") - reach, "_to": F.col("stop") + reach}), "quantity-spans")
    c = materialize(cut(names.select(id_col, "name", "category", "start", "stop").distinct(), False), "name-spans")
    before, behind = F.col("c.start") - F.col("q.stop"), F.col("q.start") - F.col("c.stop")
    pairs = overlaps(q, c, [id_col], ("_from", "_to"), ("start", "stop")).select(id_col, F.col("a").alias("q"), F.col("b").alias("c"))
    pairs = pairs.withColumn("distance", F.greatest(before, behind, F.lit(0)))
    pairs = pairs.withColumn("direction", F.when(before >= 0, "value first").when(behind >= 0, "name first").otherwise("overlap"))
    gap = F.when(before >= 0, F.substring("q._after", 1, before)).when(behind >= 0, F.substring(F.col("q._before"), F.length("q._before") - behind + 1, behind)).otherwise("")
    longer = lambda x, y: F.concat(F.col(f"{x}._own"), F.when(F.col(f"{y}.stop") > F.col(f"{x}.stop"), F.substring(F.col(f"{y}._own"), F.col(f"{x}.stop") - F.col(f"{y}.start") + 1, F.col(f"{y}.stop") - F.col(f"{x}.stop"))).otherwise(""))
    whole = (F.when(before >= 0, F.concat("q._own", "_gap", "c._own")).when(behind >= 0, F.concat("c._own", "_gap", "q._own"))
             .when(F.col("q.start") <= F.col("c.start"), longer("q", "c")).otherwise(longer("c", "q")))
    pairs = pairs.withColumn("_gap", gap).withColumns({"_between": F.lower("_gap"), "_whole": whole})
    add = lambda rule, x: F.when(rule, x).otherwise(0.0)
    fits = F.col("q.type").isin(list(dissolved))
    score = (1.0 - F.col("distance") / LINK_DISTANCE * LINK_FAR + add(F.col("direction") == "value first", LINK_VALUE_FIRST) + add(F.col("direction") == "name first", LINK_NAME_FIRST)
             + add(F.col("_between").rlike(LINK_STOPS), LINK_STOP) + add(F.col("_between").rlike(LINK_JOINS), LINK_JOIN) + add(F.col("_between").rlike(LINK_OFS), LINK_OF)
             + add(F.contains("_whole", F.lit("(")) & F.contains("_whole", F.lit(")")), LINK_BRACKETS) + add(fits & F.col("c.category").isin(list(classes)), LINK_CLASS) + add(fits & F.col("_whole").rlike(LINK_SOLUTIONS), LINK_SOLUTION))
    # what scores least goes after the grouping: a filter here is moved into the join, where the score is worked out once more, and each part of it anew
    pairs = pairs.withColumn("score", F.round(score, 4))
    own = F.struct(*[F.col(f"q.`{x}`") for x in once.columns])
    order = F.struct((-F.col("score")).alias("s"), F.abs(F.col("c.start") - F.col("q.stop")).alias("d"), F.col("c.start"), F.col("c.name"), F.col("c.category"))
    best = pairs.groupBy(id_col, own.alias("q")).agg(F.min_by(F.struct("c.name", "c.category", "direction", "distance", "score"), order).alias("x"))
    return best.where(F.col("x.score") >= LINK_LEAST).select("q.*", "x.*")


def direct_links(df: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, tuple[str, float]]) -> DataFrame:
    """id_col, name, quantity, score: pairs found by patterns whose groups 1 and 2 are quantity and name; the best score of a pair, then the longest name of a quantity."""
    parts = []
    for pattern, score in patterns.values():
        zipped = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("q"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("n"))
        parts.append(df.select(id_col, F.explode(zipped).alias("x"), F.lit(score).alias("score")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    pairs = both.groupBy(id_col, F.col("x.q").alias("quantity"), F.col("x.n").alias("name")).agg(F.max("score").alias("score"))
    return pairs.groupBy(id_col, "quantity").agg(F.max(F.struct(F.length("name").alias("l"), "name", "score")).alias("x")).select(id_col, "quantity", "x.name", "x.score")


# Fixed values of the direct forms: the units of each kind of quantity and what a form scores, by its name.
UNITS = {"mass": ("mg", "kg", "g"), "volume": ("uL", "µL", "mL", "L"), "amount": ("mmol", "mol"), "concentration": ("mM", "M"), "fraction": ("wt%", "wt. %", "%")}
FORMS = {
    "quantity_of_name": ("[QC]ow*D", 0.95), "quantity_then_name": ("[QC]w*D", 0.90), "name_parenthesis_quantity": (r"D\([QC]\)", 0.95),
    "concentration_name_solution": ("Cw*Ds", 0.95), "solution_of_concentration_name": ("soCw*D", 0.95), "name_solution_of_concentration": ("DsoC", 0.95),
}


def text_symbols(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, units: Mapping[str, Sequence[str]] = UNITS, most_words: int = 4) -> DataFrame:
    """id_col, symbols: a text as an array of (pos, sym, token, name, type): Q a quantity, C a concentration, D a term of terms(term, name) (the longest at its
    place), o "of", s "solution", ( and ), . a stop or a verb that ends a name (was, were, is, are), w any other word.

    Terms are found by equi-joins of runs of words, so the dictionary may be of any size. Ids are those of single texts.
    """
    df = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    unit = "|".join(re.escape(u) for u in sorted((u for us in units.values() for u in us), key=len, reverse=True))
    quantity = rf"[0-9]+(?:\.[0-9]+)?\s*(?:{unit})(?![A-Za-z])"
    tokens = F.regexp_extract_all("_text", F.lit(rf"{quantity}|[A-Za-z]+|[().;]"), F.lit(0))
    is_word = lambda x: x.rlike("^[A-Za-z]")
    numbered = F.transform(F.array(tokens), lambda ts: F.arrays_zip(ts.alias("token"), running_sums(F.transform(ts, lambda x: is_word(x).cast("int"))).alias("word_no")))[0]
    rows = df.select("_id", F.posexplode(numbered).alias("pos", "x")).select("_id", "pos", F.col("x.token").alias("token"), F.col("x.word_no").alias("word_no"))
    rows = rows.withColumn("word_no", F.when(is_word(F.col("token")), F.col("word_no")))
    hits = phrase_spans(df.select("_id", F.regexp_replace("_text", quantity, " 0 ").alias("_t")), "_id", "_t", terms, most_words)
    cover = hits.select("_id", "name", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("k"), "nth").select("_id", (F.col("nth") + F.col("k")).alias("word_no"), "k", "name")
    of = F.regexp_extract(F.col("token"), r"^[0-9.]+\s*(.+)$", 1)
    kind = F.lit(None).cast("string")
    for name, us in units.items():
        kind = F.coalesce(kind, F.when(of.isin(list(us)), name))
    low = F.lower("token")
    sym = (F.when(F.col("k") == 0, "D").when(F.col("type") == "concentration", "C").when(F.col("type").isNotNull(), "Q").when(low == "of", "o").when(low == "solution", "s")
           .when(low.isin("(", ")"), low).when(low.isin(".", ";", "was", "were", "is", "are"), ".").otherwise("w"))
    marked = rows.join(cover, ["_id", "word_no"], "left").where("k is null or k = 0").withColumn("type", kind).withColumn("sym", sym)
    return marked.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym", "token", "name", "type"))).alias("symbols")).withColumnRenamed("_id", id_col)  # one text's


def symbol_links(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, units: Mapping[str, Sequence[str]] = UNITS, forms: Mapping[str, tuple[str, float]] = FORMS) -> DataFrame:
    """id_col, name, type, value, unit, form, score: quantities and names that stand in one of the forms, which are patterns over text_symbols().

    A quantity's names are those of its best form (the surest, then the first by name); the same name, type, value and unit come once in a text. Null texts have no links.
    """
    line = F.array_join(F.transform("symbols", lambda x: x["sym"]), "")

    def of_form(name: str, pattern: str, score: float) -> Column:
        return F.transform(spans(line, pattern), lambda x: F.struct(F.lit(name).alias("form"), F.lit(score).alias("score"), x["start"].alias("start"), x["stop"].alias("stop")))

    found = [of_form(name, pattern, score) for name, (pattern, score) in forms.items()]
    rows = text_symbols(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", terms, units).select("_id", "symbols", F.explode(F.flatten(F.array(*found))).alias("m"))
    part = F.slice("symbols", F.col("m.start") + 1, F.col("m.stop") - F.col("m.start"))
    one = lambda test: F.get(F.filter("part", test), F.lit(0))
    pairs = rows.select("_id", part.alias("part"), "m.form", "m.score").select("_id", one(lambda x: x["type"].isNotNull()).alias("q"), one(lambda x: x["sym"] == "D").alias("d"), "form", "score")
    best = pairs.groupBy("_id", F.col("q.pos").alias("at")).agg(F.min_by(F.struct("q", "d", "form", "score"), F.struct((-F.col("score")).alias("s"), "form")).alias("x"))
    cells = best.select("_id", "at", "x.*").select(
        "_id", F.col("d.name").alias("name"), F.col("q.type").alias("type"), F.regexp_extract("q.token", r"^[0-9.]+", 0).try_cast("double").alias("value"), F.regexp_extract("q.token", r"^[0-9.]+\s*(.+)$", 1).alias("unit"), "form", "score", "at")
    return cells.groupBy("_id", "name", "type", "value", "unit").agg(F.min_by(F.struct("form", "score"), F.struct((-F.col("score")).alias("s"), "at")).alias("x")).select("_id", "name", "type", "value", "unit", "x.form", "x.score").withColumnRenamed("_id", id_col)


def merge_links(direct: DataFrame, proximity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both kinds of links: of each key the row with the best score, with all its columns (missing ones are null); ties go to the greater of the other values."""
    both = direct.unionByName(proximity, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "score")]
    return both.groupBy(*keys).agg(F.max(F.struct("score", *rest)).alias("_x")).select(*keys, "_x.*")
