"""Filters, joins, patches, windows and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.operators.quantiles import quantiles
from graintable.sources.files import materialize


def min_present(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return df.na.drop(thresh=k, subset=list(columns))


def explore(df: DataFrame, search: str | None = None, text_columns: Sequence[str] = (), between: tuple[str, object, object] | None = None,
            among: tuple[str, Sequence] | None = None, flag: str | None = None, least: tuple[str, float] | None = None) -> DataFrame:
    """Rows that meet every filter that is given: text in any column, range, list, flag, least score (null counts as 0)."""
    keep = F.lit(True)
    if search:
        keep = keep & F.contains(F.lower(F.concat_ws("\n", *text_columns)), F.lit(search.lower()))
    if between:
        keep = keep & F.col(between[0]).between(between[1], between[2])
    if among:
        keep = keep & F.col(among[0]).isin(list(among[1]))
    if flag:
        keep = keep & F.coalesce(F.col(flag), F.lit(False))
    if least:
        keep = keep & (F.coalesce(F.col(least[0]), F.lit(0)) >= least[1])
    return df.where(keep)


def quality_gate(df: DataFrame, score: str, summary: str, flag: str, least: float) -> DataFrame:
    """Score of at least `least` (null: 0), a summary that isn't empty, and a flag that isn't false."""
    return df.where((F.coalesce(F.col(score), F.lit(0)) >= least) & (F.coalesce(F.col(summary), F.lit("")) != "") & (~F.col(flag).eqNullSafe(F.lit(False))))


def tier_filter(docs: DataFrame, children: DataFrame, bodies: DataFrame, key: str, keep_rule: Column, drop_rule: Column, other: Column, body_rule: Column) -> DataFrame:
    """docs with tier and kept: a keyword hit keeps; neither on topic nor with children drops; explicit 'other' drops; else the body decides (no body: keep)."""
    flagged = docs.join(children.select(key).distinct().withColumn("_child", F.lit(True)), key, "left").join(bodies, key, "left")
    tier = (F.when(keep_rule, "keyword").when(~drop_rule & F.col("_child").isNull(), "no children").when(other, "other")
            .when(body_rule.isNull(), "no body").when(body_rule, "body").otherwise("off body"))
    return flagged.withColumn("tier", tier).withColumn("kept", F.col("tier").isin("keyword", "no body", "body")).select(*docs.columns, "tier", "kept")


def suspicious_values(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """check, n: how many texts each pattern is found in."""
    counts = df.agg(*[F.count_if(F.col(column).rlike(p)).alias(name) for name, p in patterns])
    return counts.unpivot([], [n for n, _ in patterns], "check", "n")


def numeric_report(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: filled, below, above, least, median, 99th percentile and greatest of a numeric column."""
    c = F.col(column).cast("double")
    one = df.agg(F.count(c).alias("filled"), F.count_if(c < low).alias("below"), F.count_if(c > high).alias("above"), F.min(c).alias("least"), F.max(c).alias("greatest"))
    q = quantiles(df.select(c.alias("_x")), "_x", [0.5, 0.99])
    return one.crossJoin(F.broadcast(q)).select("filled", "below", "above", "least", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("q99"), "greatest")  # one row each


def select_incomplete(df: DataFrame, fields: Sequence[str], texts: DataFrame, key: str) -> DataFrame:
    """Rows with a null among fields whose key has a text."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return df.where(missing).join(texts.select(key), key, "left_semi")


# -- joins

def fill_from(child: DataFrame, parent: DataFrame, on: str, columns: Sequence[str], order: str) -> DataFrame:
    """Null child fields take the parent's value; of parents with one key the last by `order` counts; null keys match nothing."""
    last = parent.groupBy(on).agg(*[F.max_by(c, order).alias(f"_p_{c}") for c in columns])
    return child.join(last, on, "left").select(*[F.coalesce(c, f"_p_{c}").alias(c) if c in columns else F.col(c) for c in child.columns])


def fill_from_first(parent: DataFrame, child: DataFrame, on: str, column: str, order: Column, valid: Column) -> DataFrame:
    """A null parent field takes the first valid child value of the key."""
    first = child.where(valid).groupBy(on).agg(F.min_by(column, order).alias("_c"))
    return parent.join(first, on, "left").withColumn(column, F.coalesce(column, "_c")).drop("_c")


def one_per_key(df: DataFrame, on: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """on and columns, one row a key: of several rows each column's last known value by order; without an order the greatest."""
    return df.groupBy(on).agg(*[(F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))).alias(c) for c in columns])


def apply_patch(df: DataFrame, patch: DataFrame, on: str, columns: Sequence[str], mode: str = "overwrite", order: str | None = None) -> DataFrame:
    """Patch values that aren't null replace ('overwrite') or fill nulls ('fill'); null patches never erase. changed_ tells rows that differ.

    A key that occurs several times in the patch counts once (see one_per_key), so rows of df never multiply.
    """
    p = one_per_key(patch, on, columns, order).select(on, *[F.col(c).alias(f"_n_{c}") for c in columns])
    new = {c: F.coalesce(f"_n_{c}", c) if mode == "overwrite" else F.coalesce(c, f"_n_{c}") for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~new[c].eqNullSafe(F.col(c))
    return df.join(p, on, "left").select(*[new[c].alias(c) if c in columns else F.col(c) for c in df.columns], changed.alias("changed_"))


def filled_counts(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, filled: how many more values after has than before."""
    one = before.agg(*[F.count(c).alias(f"_a_{c}") for c in columns]).crossJoin(F.broadcast(after.agg(*[F.count(c).alias(f"_b_{c}") for c in columns])))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"_b_{c}") - F.col(f"_a_{c}")).alias("filled")) for c in columns])))


def rescue(df: DataFrame, key: str, column: str, when: Column, cache: DataFrame) -> DataFrame:
    """Values of the rows that meet `when` are replaced by those that cache(key, value) knows."""
    c = one_per_key(cache, key, ["value"]).withColumnRenamed("value", "_c")
    return df.join(c, key, "left").withColumn(column, F.when(when & F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col(column))).select(*df.columns)


def to_pairs(turns: DataFrame, conversation: str, turn: str, role: str, text: str, asks: str, prefix: str = "") -> DataFrame:
    """conversation, turn, instruction, output: each turn of the asking role with the turn behind it."""
    after = turns.select(conversation, (F.col(turn) - 1).alias(turn), F.col(text).alias("output"))
    return turns.where(F.col(role) == asks).join(after, [conversation, turn]).select(conversation, turn, F.concat(F.lit(prefix), F.col(text)).alias("instruction"), "output")


def filter_samples(df: DataFrame, filled: Sequence[str] = (), positive: Sequence[str] = (), equal: dict | None = None) -> DataFrame:
    """Rows with all of `filled` known, all of `positive` above 0, and the given values."""
    keep = F.lit(True)
    for c in filled:
        keep = keep & F.col(c).isNotNull()
    for c in positive:
        keep = keep & (F.col(c) > 0)
    for c, v in (equal or {}).items():
        keep = keep & (F.col(c) == v)
    return df.where(keep)


def flag_in(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    return df.join(keys.select(on).distinct().withColumn("_f", F.lit(True)), on, "left").withColumn(name, F.col("_f").isNotNull()).drop("_f")


def recover(df: DataFrame, key: str, column: str, cache: DataFrame, texts: DataFrame, tags: DataFrame, by_section: Column, by_text: Column, common: Sequence[str] = ()) -> DataFrame:
    """Value 'other' is replaced by the cache's, else the section rule's, else the whole text's, else a single tag, else 'unidentified'.

    by_section and by_text are columns of texts. A whole text names `common` values for many reasons: such a hit counts only where no tag
    is known. Keys that occur several times in cache, texts or tags count once, by the greatest value.
    """
    caches = one_per_key(cache, key, ["value"]).withColumnRenamed("value", "_cache")
    tagged = one_per_key(tags, key, ["tag"]).withColumnRenamed("tag", "_tag")
    # the rules are worked out where the texts are read; labels, not texts, go into the aggregation
    ruled = one_per_key(texts.select(key, by_section.alias("_section"), by_text.alias("_text")), key, ["_section", "_text"])
    joined = df.join(caches, key, "left").join(ruled, key, "left").join(tagged, key, "left")
    distinctive = F.when(F.col("_text").isin(list(common)), F.lit(None)).otherwise(F.col("_text")) if common else F.col("_text")
    found = F.coalesce("_cache", "_section", distinctive, "_tag", "_text", F.lit("unidentified"))
    return joined.withColumn(column, F.when(F.col(column) == "other", found).otherwise(F.col(column))).select(*df.columns)


def availability(docs: DataFrame, texts: DataFrame, files: DataFrame, key: str, abstract: str) -> DataFrame:
    """class, n: documents with a text, a file only, an abstract only, or nothing."""
    flags = flag_in(flag_in(docs, texts, key, "_t"), files, key, "_l")
    kind = F.when(F.col("_t"), "text").when(F.col("_l"), "file only").when(F.col(abstract).isNotNull(), "abstract only").otherwise("none")
    return flags.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def score_targets(candidates: DataFrame, targets: DataFrame, score: Column, limit: int = 10_000) -> DataFrame:
    """Every candidate against every target of a stated list of at most `limit` targets."""
    if targets.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} targets")
    return candidates.crossJoin(F.broadcast(targets)).withColumn("score", score)


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """n: keys on both sides."""
    return train.select(key).distinct().join(test.select(key).distinct(), key).agg(F.count("*").alias("n"))


def oof_group_mean(df: DataFrame, fold: str, key: str, y: str) -> DataFrame:
    """df with oof_mean: the mean of y over the key's rows in other folds, else over all rows of other folds."""
    cells = df.groupBy(fold, key).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    keyed = cells.withColumn("_ks", F.sum("_s").over(Window.partitionBy(key))).withColumn("_kn", F.sum("_n").over(Window.partitionBy(key)))
    folds = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    total = folds.agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    folds = folds.crossJoin(F.broadcast(total))  # one row
    mean = F.coalesce(F.try_divide((F.col("_ks") - F.col("_s")).cast("double"), F.col("_kn") - F.col("_n")), F.try_divide((F.col("_ts") - F.col("_fs")).cast("double"), F.col("_tn") - F.col("_fn")))
    return df.join(keyed, [fold, key]).join(folds, fold).withColumn("oof_mean", mean).select(*df.columns, "oof_mean")


def encode(df: DataFrame, column: str, vocabulary: DataFrame, out: str, size: int) -> DataFrame:
    """df with the number of each value in vocabulary(value, code); unknown values get `size`; of a value's codes the least counts."""
    v = vocabulary.groupBy(F.col("value").alias(column)).agg(F.min("code").alias("_code"))
    return df.join(v, column, "left").withColumn(out, F.coalesce("_code", F.lit(size))).drop("_code")


# -- windows

def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedup_by_title(df: DataFrame, title: str, order: Sequence[Column]) -> DataFrame:
    """First row of each title, compared by its letters and digits of all scripts in lower case; rows whose title has none, or is null, all stay."""
    bare = F.coalesce(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", ""), F.lit(""))
    keyed = df.withColumn("_h", F.when(bare != "", F.md5(bare)))
    return first_per_key(keyed.where("_h is not null"), ["_h"], order).unionByName(keyed.where("_h is null")).drop("_h")


def diverse_top_k(df: DataFrame, score: Column, groups: Sequence[str], per: int, k: int, tie: str) -> DataFrame:
    """The k best rows with at most `per` of each group."""
    w = Window.partitionBy(*groups).orderBy(score.desc(), F.col(tie))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r").orderBy(score.desc(), F.col(tie)).limit(k)


def cap_per_key(df: DataFrame, key: str, n: int, prefer: Column, position: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(prefer.desc(), F.col(position))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def assign_ids(new: DataFrame, existing: DataFrame, id_col: str, order: str, out: str = "id") -> DataFrame:
    """new with ids after existing's largest, in `order`: numbered within ranges, the ranges' sizes summed, so no task holds all rows."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_top"))
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = materialize(new.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "numbered")  # read twice: with the same borders
    inner = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (inner.join(F.broadcast(before.select("_part", "_base")), "_part").crossJoin(F.broadcast(top))
            .withColumn(out, F.col("_top") + F.col("_base") + F.col("_r")).select(*new.columns, out))


def upsert(df: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of new replace rows of df with the same keys; of several new rows of a key the first by order counts."""
    both = df.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    return first_per_key(both, keys, [F.col("_g").desc(), *order]).drop("_g")


# -- sorts and sets

def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_keys(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys, the first by the md5 of key and seed as text: the same for the same seed, in any engine."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.select(key).distinct().orderBy(digest, key).limit(n)


def union_align(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def append_new(base: DataFrame, new: DataFrame, on: str) -> DataFrame:
    return base.unionByName(new.join(base.select(on), on, "left_anti"), allowMissingColumns=True)
