"""Line dedup by a log-template tree, in DataFrame functions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import materialize, table
from graintable.sources.files import Successive

#: A token with a digit is a variable field. The quantifiers are possessive: a token is read once.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
WILD = "<*>"


def template_lines(docs: DataFrame, id_col: str, text_col: str, lead: int) -> DataFrame:
    """One row per line that has a token: _id, _th (hash of the text), pos, masked, n, leaf, k1, k2.

    masked is the line in lower case, squeezed, with variable fields as <*>; leaf is the node of the
    fixed-depth tree (token count, then the leading tokens); k1, k2 are a 128-bit key of masked.
    """
    odd = functools.reduce(lambda a, b: a | b, [F.contains(F.col("line"), F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\v")])
    low = F.lower(F.col("line"))
    squeezed = F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))  # most lines have nothing to squeeze
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace(squeezed, VARIABLE, WILD)).otherwise(squeezed)
    return (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                    F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(r"\S"))
        .select("_id", "_th", "pos", masked.alias("masked"))
        .withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
        .withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", lead)))
        .withColumn("k1", F.xxhash64("masked", F.lit(1)))
        .withColumn("k2", F.xxhash64("masked", F.lit(2)))
    )


#: Candidate pairs that are compared at once, whatever the size of the input.
FEW_PAIRS = 1_000_000
#: How many of a leaf's greatest lines are settled together in its second round, and how many times as many in each further one.
BATCH, GROWTH = 64, 8


def differ_at_most(n: Column, similarity: float) -> Column:
    """Positions in which two lines of n tokens may differ and still agree."""
    return (n - F.ceil(F.lit(similarity) * n)).cast("int")


def agreement(a: Column, b: Column) -> Column:
    """Number of positions at which two masked lines have the same token."""
    return F.size(F.filter(F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: x == y), lambda x: x))


def line_parts(lines: DataFrame, similarity: float, lead: int) -> DataFrame:
    """k1, k2, part (long): lines of a leaf that agree share a part.

    They differ in at most n - ceil(similarity * n) positions, all behind the leading tokens; cut into one
    more part than that, those positions leave a part without a difference.
    """
    def cut(tokens):
        n = F.size(tokens)
        differ = differ_at_most(n, similarity)
        behind = F.greatest(n - lead, F.lit(0))
        start = lambda i: F.floor(i * behind / (differ + 1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), differ), lambda i: F.xxhash64("leaf", i, F.slice(tokens, start(i) + lead + 1, start(i + 1) - start(i))))
        return F.when(differ >= behind, F.array("leaf")).otherwise(parts)

    # in a lambda, so that a line is split once and not for each part
    return lines.select("k1", "k2", F.explode(F.flatten(F.transform(F.array(F.split("masked", " ")), cut))).alias("part"))


def templates(members: DataFrame, similarity: float, lead: int) -> DataFrame:
    """k1, k2, t1, t2: each line that agrees with another one, and the leader of its group.

    A leaf has any number of groups. Lines are taken by (docs, k1, k2), greatest first; a line joins the first
    leader it agrees with, else it leads a group of its own. A leaf's first leader is compared with all its lines. Of what it leaves, the
    lines that share a part with another one are compared; where these are few pairs, all of them at once. Else the greatest BATCH lines of
    each leaf are settled among themselves, and the leaders among them, which come before all other lines, take what agrees with them; each further
    batch is GROWTH times as large, so a leaf of any number of groups takes a number of rounds that grows as its logarithm.
    """
    if similarity > 1:
        return members.select("k1", "k2", F.col("k1").alias("t1"), F.col("k2").alias("t2")).limit(0)
    # written first, so that the join below deals its two sides by itself and a hot leaf's lines can be split
    leaders = materialize(members.groupBy("leaf").agg(F.max(F.struct("docs", "k1", "k2", "masked")).alias("lead")), "line-leaders")
    step = (members.join(leaders, "leaf").where(agreement(F.col("masked"), F.col("lead.masked")) >= F.lit(similarity) * F.size(F.split("masked", " ")))
            .select("k1", "k2", F.col("lead.k1").alias("t1"), F.col("lead.k2").alias("t2")))
    found = materialize(step, "line-step")
    rests, all_parts, batch = Successive("line-rest"), Successive("line-parts"), BATCH
    rest = rests.put(members.join(found, ["k1", "k2"], "left_anti").select(*members.columns))
    parts = all_parts.put(line_parts(rest, similarity, lead))
    while True:
        crowded = parts.groupBy("part").agg(F.count("*").alias("c")).where("c > 1")
        rows, pairs = crowded.agg(F.sum("c"), F.sum(F.expr("c * (c - 1) / 2"))).first()
        if not rows:
            return found
        parts = all_parts.put(parts.join(crowded.select("part"), "part", "left_semi"))
        rest = rests.put(rest.join(parts.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select(*members.columns))
        if pairs <= max(FEW_PAIRS, 8 * rows):
            return found.unionByName(settled(rest, parts, similarity))
        place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("docs"), F.desc("k1"), F.desc("k2")))  # of each task's rows of a leaf the first `batch` go on
        top = materialize(rest.withColumn("_r", place).where(F.col("_r") <= batch).select(*members.columns), "line-top")
        among = materialize(settled(top, materialize(parts.join(top.select("k1", "k2"), ["k1", "k2"], "left_semi"), "line-top-parts"), similarity), "line-among")
        leads = materialize(top.join(among.where("k1 <> t1 or k2 <> t2").select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", "docs", "masked"), "line-leads")
        reach = materialize(parts.join(leads.select("k1", "k2", "docs"), ["k1", "k2"]).select("part", F.struct("docs", "k1", "k2").alias("u")), "line-reach")
        others = parts.join(top.select("k1", "k2"), ["k1", "k2"], "left_anti")
        near = others.join(reach, "part").select("k1", "k2", "u").distinct()
        texts = near.join(rest.select("k1", "k2", "masked"), ["k1", "k2"]).join(leads.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("masked").alias("lead")), (F.col("u.k1") == F.col("t1")) & (F.col("u.k2") == F.col("t2")))
        hits = texts.where(agreement(F.col("masked"), F.col("lead")) >= F.lit(similarity) * F.size(F.split("masked", " ")))
        taken = materialize(hits.groupBy("k1", "k2").agg(F.max("u").alias("u")).select("k1", "k2", F.col("u.k1").alias("t1"), F.col("u.k2").alias("t2")), "line-hits")
        own = taken.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "t1", "t2").distinct()
        found = found.unionByName(among).unionByName(taken).unionByName(own.join(among.select("k1", "k2"), ["k1", "k2"], "left_anti"))
        gone = materialize(top.select("k1", "k2").unionByName(taken.select("k1", "k2")), "line-gone")
        rest = rests.put(rest.join(gone, ["k1", "k2"], "left_anti").select(*members.columns))
        parts = all_parts.put(parts.join(gone, ["k1", "k2"], "left_anti").select("k1", "k2", "part"))
        batch *= GROWTH


#: Bits of the coarse set of leaves, 64 in a word: its 2^18 rows at most are what is broadcast, whatever the number of leaves.
LEAF_BITS = 1 << 24


def lines_of_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose leaf is among leaves(leaf).

    Texts are what is large and few of them are wanted, so a coarse set of the leaves' hashes goes to where the lines are made; what it lets through, the
    wanted lines and few others, is shuffled for the exact join.
    """
    at = F.col("leaf").bitwiseAND(LEAF_BITS - 1)  # never null, so that no check for nulls makes the masked text once more
    word, bit = F.shiftright(at, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    coarse = leaves.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    near = lines.withColumn("_word", F.shiftright(at, 6)).join(F.broadcast(coarse), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    # written, as the optimizer would put the exact join before the coarse one
    return materialize(near.select(*lines.columns), "line-near").join(leaves.select("leaf"), "leaf", "left_semi")


def settled(rest: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """k1, k2, t1, t2 as templates() has them, from the pairs of lines that share a part."""
    sides = [parts.join(rest, ["k1", "k2"]).select("part", F.struct("docs", "k1", "k2").alias(x), F.col("masked").alias(f"{x}_text")) for x in ("u", "v")]
    # most pairs of a crowded part don't agree: they are told before the same pair of several parts is made one
    links = sides[0].join(sides[1], "part").where("u > v").where(agreement(F.col("u_text"), F.col("v_text")) >= F.lit(similarity) * F.size(F.split("u_text", " ")))
    links = materialize(links.select("u", "v").distinct(), "line-links")
    open_links, taken = links, None
    while not open_links.isEmpty():
        # a line without an open link to an earlier one leads; what agrees with it doesn't
        first = open_links.select("u").distinct().join(open_links.select(F.col("v").alias("u")), "u", "left_anti")
        hit = materialize(open_links.join(first, "u").select("v").distinct(), "line-taken")
        taken = hit if taken is None else taken.unionByName(hit)
        left = open_links.join(hit, "v", "left_anti").join(hit.withColumnRenamed("v", "u"), "u", "left_anti")
        open_links = materialize(left.join(first, "u", "left_anti").select("u", "v"), "line-open")
    if taken is None:
        return links.select("u.k1", "u.k2", F.col("v.k1").alias("t1"), F.col("v.k2").alias("t2"))
    groups = links.join(taken.withColumnRenamed("v", "u"), "u", "left_anti").groupBy("v").agg(F.max("u").alias("u"))
    of = lambda x: [F.col(f"{x}.k1").alias("k1"), F.col(f"{x}.k2").alias("k2"), F.col("u.k1").alias("t1"), F.col("u.k2").alias("t2")]
    return groups.select(*of("v")).unionByName(groups.select(*of("u")).distinct())


def recurring_templates(lines: DataFrame, keyed: DataFrame, min_docs: int, similarity: float, lead: int) -> DataFrame:
    """k1, k2, first_id, docs of each masked line (keyed: lines without their text) whose template occurs in min_docs documents or more.

    Masked lines of a leaf that agree with a group's leading line in at least the share `similarity` of
    positions share its template; a leaf has as many groups as its lines need (see templates()).
    """
    occurrences = materialize(keyed.groupBy("k1", "k2", "_id").agg(
        F.first("leaf").alias("leaf"), F.first("n").alias("n")), "line-occurrences")
    keys = occurrences.groupBy("k1", "k2", "leaf", "n").agg(F.count("*").alias("docs"), F.min("_id").alias("first_id"))
    keys = materialize(keys, "line-keys")
    may_differ = differ_at_most(F.col("n"), similarity) > 0  # shorter lines agree with themselves only
    crowded = materialize(keys.where(may_differ).groupBy("leaf").agg(F.count("*").alias("members")).where("members > 1"), "line-leaves")
    # a leaf's lines have as many tokens, so all of these may differ; distinct rows, not the first text of each key: that would sort all occurrences
    texts = lines_of_leaves(lines.select("k1", "k2", "leaf", "masked"), crowded.select("leaf")).select("k1", "k2", "leaf", "masked").distinct()
    members = materialize(texts.join(keys.select("k1", "k2", "docs"), ["k1", "k2"]), "line-members")
    merged = materialize(templates(members, similarity, lead), "line-merged")
    # templates of one masked line need no further work; those of several are counted anew over distinct documents
    shared = merged.where("k1 <> t1 or k2 <> t2").select("t1", "t2").distinct()
    joint = merged.join(shared, ["t1", "t2"], "left_semi")
    counted = (occurrences.join(joint, ["k1", "k2"]).groupBy("t1", "t2", "_id").agg(F.lit(1).alias("one"))
               .groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.min("_id").alias("first_id")))
    several = (joint.join(counted, ["t1", "t2"]).where(F.col("docs") >= min_docs).select("k1", "k2", "first_id", "docs"))
    single = keys.where(F.col("docs") >= min_docs).join(joint, ["k1", "k2"], "left_anti").select("k1", "k2", "first_id", "docs")
    return single.unionByName(several)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
                similarity: float = 0.8, lead: int = 3) -> DataFrame:
    """docs with text_col cut to the lines that are kept, plus n_lines_ and n_dropped_ (long).

    Lines of a template that recurs in min_docs documents or more stay in the document with the smallest
    id only and go from all others, on whole texts and over all documents. Other columns pass through, whatever their names; ones
    named n_lines_ or n_dropped_ are replaced. Null text stays null, with 0 lines; blank lines
    stay where they are; a text all of whose lines go becomes empty. Repeated rows are treated alike;
    rows with a null id count as one document, which is never the one that keeps a line when
    another id has it.
    """
    kept_columns = docs.columns
    lines = template_lines(docs, id_col, text_col, lead)
    keyed = materialize(lines.drop("masked"), "line-hashes")
    recurring = materialize(recurring_templates(lines, keyed, min_docs, similarity, lead), "line-recurring")
    gone = (keyed.select("_id", "_th", "pos", "k1", "k2").join(recurring, ["k1", "k2"])
            .where(~F.col("_id").eqNullSafe(F.col("first_id")))
            .groupBy("_id", "_th").agg(F.collect_set("pos").alias("_gone")))
    right = gone.withColumnsRenamed({"_id": "_gid", "_th": "_gth"})
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.xxhash64(F.col(text_col)).alias("_gt"))
    body = F.col("_row")[text_col]
    joined = here.join(right, F.col("_row")[id_col].eqNullSafe(F.col("_gid")) & (F.col("_gt") == F.col("_gth")), "left")
    parts = F.split(body, "\n")
    # positions by a hash set, in order; in a lambda, so that a text is split once and not for each line
    left = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_gone")), lambda i: F.get(p, i))
    rest = F.array_join(F.transform(F.array(parts), left)[0], "\n")
    text = F.when(F.col("_gone").isNull(), body).otherwise(rest)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in kept_columns if c not in ("n_lines_", "n_dropped_")],
        F.when(body.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines_"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped_"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their kept lines, n_lines and n_dropped; odd rows: see dedup_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).withColumnsRenamed({"n_lines_": "n_lines", "n_dropped_": "n_dropped"})
