"""Model jobs on Spark ML: folds, encoders, tree models, importance, candidate search, intervals, comparison."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.operators.aggregates import regression_metrics, same_keys
from graintable.operators.intervals import overlaps
from graintable.operators.quantiles import known, numbered_values, quantiles
from graintable.operators.relational import assign_ids
from graintable.sources.files import materialize


def assign_group_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """A fold by the md5 of the key as text, so that no key is in two folds and any engine can check it."""
    head = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (head % k).cast("int"))


def group_holdout(df: DataFrame, key: str, percent: int) -> DataFrame:
    """df with held_out: about that share of the keys."""
    return assign_group_folds(df, key, 100, "_f").withColumn("held_out", F.col("_f") < percent).drop("_f")


def feature_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median imputation with missing flags, indexed categories (unknown: one more), one vector."""
    return [Imputer(inputCols=list(numeric), outputCols=[f"{c}_i" for c in numeric], strategy="median"),
            *([StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_x" for c in categorical], handleInvalid="keep")] if categorical else []),
            VectorAssembler(inputCols=[f"{c}_i" for c in numeric] + [f"{c}_m" for c in numeric] + [f"{c}_x" for c in categorical], outputCol="features", handleInvalid="keep")]


def with_missing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_m": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.lower(F.trim(c)), F.lit("unknown")) for c in categorical})


def fit_regressor(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), rounds: int = 10, depth: int = 4) -> PipelineModel:
    """Boosted trees on the log of the target."""
    data = with_missing(df.where(F.col(target) > 0), numeric, categorical).withColumn("label", F.log(target))
    return Pipeline(stages=[*feature_stages(numeric, categorical), GBTRegressor(maxIter=rounds, maxDepth=depth, maxBins=64, seed=3, predictionCol="log_p")]).fit(data)


def predict(model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """df with p, the prediction in the target's unit."""
    return model.transform(with_missing(df, numeric, categorical)).withColumn("p", F.exp("log_p")).select(*df.columns, "p")


def cross_validate(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: str, k: int, **learner: int) -> DataFrame:
    """fold and regression metrics of out-of-fold predictions with folds by key; k is small and fixed, one model each."""
    folded = materialize(assign_group_folds(df.where(F.col(target) > 0), key, k), "folds")  # read by every pass of every fold
    out = None
    for i in range(k):
        model = fit_regressor(folded.where(F.col("fold") != i), target, numeric, categorical, **learner)
        part = predict(model, folded.where(F.col("fold") == i), numeric, categorical)
        out = part if out is None else out.unionByName(part)
    return regression_metrics(out, target, "p", ["fold"])


def fit_classifier(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), trees: int = 15) -> PipelineModel:
    stages = [StringIndexer(inputCol=label, outputCol="label_x", handleInvalid="keep"), *feature_stages(numeric, categorical),
              RandomForestClassifier(labelCol="label_x", numTrees=trees, maxDepth=6, maxBins=64, seed=5)]
    return Pipeline(stages=stages).fit(with_missing(df.where(F.col(label).isNotNull()), numeric, categorical))


def target_encode(df: DataFrame, fold: str, key: str, y: str, weight: float) -> DataFrame:
    """df with encoded: the key's mean of y in other folds, drawn to the other folds' mean by `weight` rows of it."""
    cells = df.groupBy(fold, key).agg(F.sum(y).cast("double").alias("_s"), F.count(y).alias("_n"))
    keys = cells.groupBy(key).agg(F.sum("_s").alias("_ks"), F.sum("_n").alias("_kn"))
    folds = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    total = folds.agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    prior = F.try_divide(F.col("_ts") - F.col("_fs"), F.col("_tn") - F.col("_fn"))
    value = (F.col("_ks") - F.col("_s") + prior * weight) / (F.col("_kn") - F.col("_n") + weight)
    table = cells.join(keys, key).join(folds, fold).crossJoin(F.broadcast(total)).select(fold, key, value.alias("encoded"))
    return df.join(table, [fold, key])


def permutation_importance(model: PipelineModel, held_out: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], columns: Sequence[str], repeats: int) -> DataFrame:
    """column, importance: mean loss of log r2 on held-out rows when a column's values change places among them.

    Rows are numbered once in a hashed order, by ranges; a value moves to the row that a repeat's offset tells, in an equi-join on the number.
    """
    spark, names = held_out.sparkSession, held_out.columns
    hashed = held_out.withColumn("_h", F.xxhash64(*names, F.lit(5)))
    rows = materialize(assign_ids(hashed, spark.createDataFrame([], "id long"), "id", "_h", "_i").drop("_h"), "permuted")
    n = rows.count()
    score = lambda df: regression_metrics(predict(model, df, numeric, categorical), target, "p", median=False).first()["log_r2"]
    base, out = score(rows.drop("_i")), []
    for c in columns:
        loss = 0.0
        for r in range(repeats):
            offset = 1 + (n * (2 * r + 1)) // (2 * repeats)
            moved = rows.select((F.pmod(F.col("_i") - 1 + offset, F.lit(n)) + 1).alias("_i"), F.col(c).alias("_new"))
            loss += base - score(rows.join(moved, "_i").withColumn(c, F.col("_new")).select(*names))
        out.append((c, loss / repeats))
    return spark.createDataFrame(out, "column string, importance double")


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 up to 1 that hangs on the seed and the keys only, so a task that runs again draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**53)) / F.lit(float(2**53))


def draw_values(draws: DataFrame, df: DataFrame, column: str, by: Sequence[str] = (), u: str = "u", weighted: bool = False, top: int | None = None, extra: str | None = None) -> DataFrame:
    """draws(by, u, ...) with a value of df's column for each, null if the group has none; u is uniform from 0 up to 1.

    Each distinct value of the draw's group is as likely as another, or as often as it occurs (weighted); only the `top` most frequent ones count if given (ties by
    value), and `extra` is one value more that is as likely as each of them (or, weighted, as one row). NaN and null are no values, a null group has none.

    A value holds the places from those before it in its group's order up to its own count, a draw asks for one place: they meet in a join of
    intervals, so a value costs the same however often it occurs, and no row holds its places.
    """
    by = list(by)
    has_group = F.lit(True)
    for c in by:
        has_group = has_group & F.col(c).isNotNull()
    if column in draws.columns:
        draws = draws.drop(column)
    rows = df.where(has_group & known(df, column)).select(*by, F.col(column).alias("_value"))
    if top is not None:
        counts = rows.groupBy(*by, "_value").agg(F.count("*").alias("_n"))
        if by:
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_value"))  # of distinct values, of which each task passes on `top` at most
            best = counts.withColumn("_r", rank).where(F.col("_r") <= top)
        else:
            best = counts.orderBy(F.desc("_n"), "_value").limit(top)
        rows = rows.join(best.select(*by, "_value"), [*by, "_value"], "left_semi")
    if extra is not None:
        rows = rows.unionByName(draws.where(has_group).select(*by).distinct().withColumn("_value", F.lit(extra)) if by else rows.sparkSession.range(1).select(F.lit(extra).alias("_value")))
    values = numbered_values(rows if weighted else rows.distinct(), "_value", by)
    values = materialize(values.select(*by, "_value", F.col("_before").alias("_first"), (F.col("_before") + F.col("_n") - 1).alias("_last"), "_total"), "values")
    totals = values.groupBy(*by).agg(F.max("_total").alias("_total"))
    whole = F.struct(*[F.col(f"`{c}`") for c in draws.columns])
    asked = draws.select(*by, F.col(u).alias("_u"), whole.alias("_draw"))
    asked = asked.join(totals, by, "left") if by else asked.crossJoin(F.broadcast(totals))  # one row
    placed = asked.withColumn("_at", F.least(F.floor(F.col("_u") * F.col("_total")), F.col("_total") - 1).cast("long"))
    found = overlaps(values.drop("_total"), placed.where("_at is not null"), by, ("_first", "_last"), ("_at", "_at"))
    none = placed.where("_at is null").select("_draw.*", F.lit(None).cast(values.schema["_value"].dataType).alias(column))
    return found.select("b._draw.*", F.col("a._value").alias(column)).unionByName(none)


Ranges = Mapping[str, tuple[str, Mapping[str, tuple[float, float]], tuple[float, float] | None]]


def _drawn(out: DataFrame, df: DataFrame, by: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], seed: int, low: float, high: float, weighted: bool, pools: Mapping[str, int], extra: Mapping[str, str], ranges: Ranges, choices: Mapping[str, Sequence]) -> DataFrame:
    """out(by, candidate) with a column for each of categorical, choices, ranges and numeric."""
    draw = lambda i: uniform(seed + i, *[F.col(c) for c in by], F.col("candidate"))
    for i, c in enumerate(categorical):
        out = materialize(draw_values(out.withColumn("_u", draw(100 + i)), df, c, by, "_u", weighted, pools.get(c), extra.get(c)).drop("_u"), "draws")
    for i, (c, values) in enumerate(choices.items()):
        out = out.withColumn(c, F.get(F.array(*[F.lit(v) for v in values]), F.floor(draw(200 + i) * len(values)).cast("int")))
    for i, c in enumerate(numeric):
        if c in ranges:
            of, known_ranges, default = ranges[c]
            ends = F.create_map(*[x for k, r in known_ranges.items() for x in (F.lit(k), F.array(F.lit(float(r[0])), F.lit(float(r[1]))))]) if known_ranges else F.lit(None).cast("map<string,array<double>>")
            other = F.array(*[F.lit(float(x)) for x in default]) if default else F.lit(None).cast("array<double>")
            out = out.withColumn("_q", F.coalesce(F.try_element_at(ends, F.col(of)), other))
        else:
            q = quantiles(df.select(*by, F.col(c).cast("double").alias("_x")), "_x", [low, high], by, "_q")
            out = out.join(q, list(by), "left") if by else out.crossJoin(F.broadcast(q))  # one row
        a, b = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
        out = out.withColumn(c, a + draw(i) * (b - a)).drop("_q")
    return out


def generate_candidates(df: DataFrame, n: int, numeric: Sequence[str], categorical: Sequence[str], seed: int, low: float = 0.05, high: float = 0.95, weighted: bool = False, pools: Mapping[str, int] | None = None,
                        extra: Mapping[str, str] | None = None, ranges: Ranges | None = None, choices: Mapping[str, Sequence] | None = None) -> DataFrame:
    """candidate (from 0) and n rows: numbers uniform between two quantiles, categories over all known values, uniformly or by how often they occur (weighted).

    pools: a column to how many of its most frequent values are drawn from; extra: a column to one value more (see draw_values). ranges: a numeric column to (a
    categorical column, that one's value to least and greatest, those of all other values or None), which stand for the quantiles. choices: a further column to
    the list of its values. The same seed draws the same rows.
    """
    out = df.sparkSession.range(n).withColumnRenamed("id", "candidate")
    return _drawn(out, df, [], numeric, categorical, seed, low, high, weighted, pools or {}, extra or {}, ranges or {}, choices or {})


def candidate_pools(df: DataFrame, by: str, methods: DataFrame, n: int, k: int, numeric: Sequence[str], categorical: Sequence[str], seed: int, score: Column, pools: Mapping[str, int] | None = None,
                    extra: Mapping[str, str] | None = None, ranges: Ranges | None = None, choices: Mapping[str, Sequence] | None = None) -> DataFrame:
    """For each of methods(by), as many as there are: n weighted candidates from its own rows, the k with the best score (ties by number); the rest as in generate_candidates().

    All methods are drawn for at once, by joins on the method. A method without rows of its own has candidates without values; a null one has none.
    """
    each = methods.where(F.col(by).isNotNull()).select(by).distinct()
    out = each.withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where(F.col("candidate").between(0, n - 1))
    scored = _drawn(out, df, [by], numeric, categorical, seed, 0.05, 0.95, True, pools or {}, extra or {}, ranges or {}, choices or {}).withColumn("score", score)
    best = Window.partitionBy(by).orderBy(F.desc("score"), "candidate")
    return scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def closeness(p: Column, target: float, width: float = 0.3) -> Column:
    """exp(-(log p - log target)**2 / (2 width**2))."""
    d = F.log(p) - F.lit(math.log(target))
    return F.exp(-(d * d) / (2 * width * width))


def inverse_design(candidates: DataFrame, prediction: str | None, target: float | None, k: int, tie: str, probability: str | None = None) -> DataFrame:
    """The k candidates most likely to reach the target: closeness, times the class probability if there is one; without a target by the probability alone."""
    if target is None and probability is None:
        raise ValueError("a target or a probability is needed")
    score = F.lit(1.0) if target is None else closeness(F.col(prediction), target)
    if probability:
        score = score * F.col(probability)
    return candidates.withColumn("score", score).orderBy(F.desc("score"), tie).limit(k)


def normal_cdf(z: Column) -> Column:
    """The normal distribution's share below z, by a rational approximation of erf with an error under 1.5e-7."""
    # The coefficients of formula 7.1.26 of Abramowitz and Stegun.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + p * x)
    series = F.lit(0.0)
    for c in reversed(a):
        series = (series + c) * t
    return F.when(z >= 0, 0.5 + 0.5 * (1 - series * F.exp(-x * x))).otherwise(0.5 - 0.5 * (1 - series * F.exp(-x * x)))


def interval_score(df: DataFrame, low: str, mid: str, high: str, target: float) -> DataFrame:
    """df with interval_score: sorted quantiles; 2 if the target is inside, plus P(within a factor of 1.25) under a normal of width/3.92, less a quarter of the width (log scale)."""
    q = F.array_sort(F.array(F.log(low), F.log(mid), F.log(high)))
    width = q[2] - q[0]
    sigma = F.greatest(width / 3.92, F.lit(0.01))
    t, near = math.log(target), math.log(1.25)
    chance = normal_cdf((F.lit(t + near) - q[1]) / sigma) - normal_cdf((F.lit(t - near) - q[1]) / sigma)
    inside = F.when(F.lit(t).between(q[0], q[2]), 2.0).otherwise(0.0)
    return df.withColumn("interval_score", inside + chance - 0.25 * width)


def fit_per_group(df: DataFrame, group: str, parent: str, features: Sequence[str], y: str, least: int, parents: int, ridge: float = 1.0) -> DataFrame:
    """group, n, intercept and weights of a ridge fit in each group with enough rows and parents: from summed products, so no group is gathered in a task."""
    names = ["one", *features]
    cells = {"one": F.lit(1.0)} | {c: F.col(c).cast("double") for c in features}
    sums = [F.sum(cells[a] * cells[b]).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(cells[a] * F.col(y).cast("double")).alias(f"y__{a}") for a in names]
    good = df.na.drop(subset=[*features, y]).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(parent).alias("_p"), *sums).where((F.col("n") >= least) & (F.col("_p") >= parents))

    def solve(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"{x}__{z}"] if f"{x}__{z}" in r else r[f"{z}__{x}"] for z in names] for x in names])
                a[np.arange(1, len(names)), np.arange(1, len(names))] += ridge
                rows.append((r[group], r["n"], list(np.linalg.solve(a, np.array([r[f"y__{x}"] for x in names])))))
            yield pd.DataFrame(rows, columns=[group, "n", "weights"])

    kind = df.schema[group].dataType.simpleString()
    return good.mapInPandas(solve, f"`{group}` {kind}, n long, weights array<double>")


def most_uncertain(df: DataFrame, probabilities: Column, k: int, tie: str) -> DataFrame:
    """The k rows with the largest entropy of class probabilities."""
    entropy = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-12))
    return df.withColumn("entropy", entropy).orderBy(F.desc("entropy"), tie).limit(k)


def most_uncertain_sigma(df: DataFrame, predictions: Sequence[str], k: int, tie: str) -> DataFrame:
    """The k rows whose models' log predictions spread most, with the one-sigma interval in the original unit."""
    logs = F.array(*[F.log(c) for c in predictions])
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / len(predictions)
    out = df.withColumn("_m", mean).withColumn("sigma", F.sqrt(F.aggregate(F.transform(logs, lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / len(predictions)))
    return out.withColumns({"low": F.exp(F.col("_m") - F.col("sigma")), "high": F.exp(F.col("_m") + F.col("sigma"))}).drop("_m").orderBy(F.desc("sigma"), tie).limit(k)


def closeness_score(mu: Column, sigma: Column, target: float) -> Column:
    return 1.0 / (F.abs(mu - F.lit(target)) + 1e-3) / (sigma + 1e-3)


def tune(df: DataFrame, target: str, numeric: Sequence[str], key: str, grid: Mapping[str, Sequence], k: int = 3) -> DataFrame:
    """One row a grid point with its mean RMSE over key folds."""
    named = with_missing(df.where(F.col(target) > 0), numeric, ()).withColumn("label", F.log(target)).select(*dict.fromkeys([*numeric, *[f"{c}_m" for c in numeric], key, "label"]))
    data = materialize(assign_group_folds(named, key, k), "tune")  # each fold's training and held-out rows are read again
    learner = LinearRegression(maxIter=20)
    points = ParamGridBuilder()
    for name, values in grid.items():
        points = points.addGrid(getattr(learner, name), list(values))
    built = points.build()
    cv = CrossValidator(estimator=Pipeline(stages=[*feature_stages(numeric, ()), learner]), estimatorParamMaps=built, evaluator=RegressionEvaluator(), numFolds=k, foldCol="fold", parallelism=2)
    scores = cv.fit(data).avgMetrics
    return df.sparkSession.createDataFrame([(", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name)), float(s)) for point, s in zip(built, scores, strict=True)], "point string, rmse double")


def halving(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: str, grid: Sequence[Mapping[str, int]], k: int = 3, shares: Sequence[int] = (25, 50, 100)) -> DataFrame:
    """rung (from 1), point, rows, score, kept: boosted trees tried by successive halving over folds of keys.

    A rung takes a growing percentage of the keys (the same ones at each size, and those of the rung before) and scores every point of the grid that is left
    (settings of fit_regressor) by the mean error of the log over k folds of these keys. The better half, rounded up, goes on; of the last rung the best is kept (ties: the
    earlier point). The grid is a stated list; each point costs k fits a rung, the rows stay on the executors.
    """
    # dealt by another digest than folds and held-out keys are, so that rungs of a part of the keys are no part of a fold
    named = df.where(F.col(target) > 0).withColumn("_rung", F.concat(F.col(key).cast("string"), F.lit(":rung")))
    parted = materialize(assign_group_folds(named, "_rung", 100, "_part").drop("_rung"), "rungs")
    alive, out = list(range(len(grid))), []
    name = lambda i: ", ".join(f"{c}={grid[i][c]}" for c in sorted(grid[i]))
    for rung, share in enumerate(shares, 1):
        rows = parted.where(F.col("_part") < share).drop("_part")
        n = rows.count()
        scored = sorted((out_of_fold_error(rows, target, numeric, categorical, key, k, grid[i]), i) for i in alive)
        kept = [i for _, i in scored[:1 if rung == len(shares) else math.ceil(len(scored) / 2)]]
        out += [(rung, name(i), n, s, i in kept) for s, i in scored]
        alive = sorted(kept)
    return df.sparkSession.createDataFrame(out, "rung int, point string, rows long, score double, kept boolean")


def out_of_fold_error(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: str, k: int, learner: Mapping[str, int]) -> float:
    """Mean absolute error of the log of the target over all rows, each predicted by a model of the other folds."""
    folded = assign_group_folds(df, key, k)
    total, n = 0.0, 0
    for i in range(k):
        model = fit_regressor(folded.where(F.col("fold") != i), target, numeric, categorical, **learner)
        row = predict(model, folded.where(F.col("fold") == i), numeric, categorical).agg(F.sum(F.abs(F.log("p") - F.log(target))), F.count("*")).first()
        total, n = total + (row[0] or 0.0), n + row[1]
    return total / n if n else float("inf")


def conformal_interval(df: DataFrame, y: str, p: str, group: str, alpha: float) -> DataFrame:
    """group, n, half: the 1 - alpha quantile of absolute residuals of held-out predictions."""
    errors = df.select(group, F.abs(F.col(y) - F.col(p)).alias("_e"))
    return same_keys(df.groupBy(group).agg(F.count("*").alias("n")), quantiles(errors, "_e", [1 - alpha], [group]), [group]).select(group, "n", F.col("q")[0].alias("half"))


def ablation(df: DataFrame, target: str, group: str, numeric: Sequence[str], key: str, subset: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """model, mae, log_r2 of a ladder on one holdout by key: global mean, group mean, ridge, boosted trees on `subset` of the numbers, on all of them, and with categories (full)."""
    split = materialize(group_holdout(df.where(F.col(target) > 0), key, 20), "holdout")
    train, test = split.where("not held_out"), split.where("held_out")
    means = train.groupBy(group).agg(F.avg(target).alias("_g"))
    overall = train.agg(F.avg(target).alias("_a"))
    based = test.crossJoin(F.broadcast(overall)).join(means, group, "left").withColumn("_g", F.coalesce("_g", "_a"))  # overall is one row
    score = lambda d, p: regression_metrics(d, target, p, median=False).select("mae", "log_r2").first()
    out = [("global mean", score(based, "_a")), ("group mean", score(based, "_g"))]
    ridge = Pipeline(stages=[*feature_stages(numeric, ()), LinearRegression(regParam=0.1, predictionCol="log_p")]).fit(with_missing(train, numeric, ()).withColumn("label", F.log(target)))
    out.append(("ridge", score(predict(ridge, test, numeric), "p")))
    for name, columns, labels in (("boosted trees, subset", list(subset), ()), ("boosted trees", list(numeric), ()), ("boosted trees, full", list(numeric), list(categorical))):
        if columns and (labels or not name.endswith("full")):
            out.append((name, score(predict(fit_regressor(train, target, columns, labels), test, columns, labels), "p")))
    return df.sparkSession.createDataFrame([(a, float(b["mae"]), b["log_r2"]) for a, b in out], "model string, mae double, log_r2 double")


def models_on_one_split(test: DataFrame, target: str, models: Mapping[str, Column]) -> DataFrame:
    """model and regression metrics of several predictions of the same held-out rows, in one pass."""
    rows = test.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in models.items()])).alias("x"))
    return regression_metrics(rows.select("y", "x.*"), "y", "p", ["model"])


def compare_same_split(metrics: DataFrame, recorded: DataFrame, gap: float = 0.05) -> DataFrame:
    """metrics(model, log_r2) beside recorded(model, log_r2) with flag where they differ by more than gap."""
    both = metrics.join(recorded.select("model", F.col("log_r2").alias("recorded")), "model", "left")
    return both.withColumn("flag", F.coalesce(F.abs(F.col("log_r2") - F.col("recorded")) > gap, F.lit(False)))


def class_probabilities(scored: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))
