"""Spatially blocked forest regression and what it leaves unexplained."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aridscape.functions.columns import defined
from aridscape.operators.forest import RandomForestRegressionModel, RandomForestRegressor
from aridscape.operators.stats import Marks, bucket_count, column_quantiles, hash_sample, spearman, with_rank
from aridscape.operators.validate import unique_labels
from aridscape.session import cut_lineage

PHYSICAL_FEATURES = ("precipitation", "soil_awc", "slope", "aspect", "lst")
DYNAMIC_FEATURE = "spi12_dynamic"
LEAKING_FEATURE = "ndvi_dry"
SAMPLE_SIZE = 100_000
#: Tasks that hold a bounded sample.
FOLD_TASKS = 2


def feature_names(criteria: Sequence[str], model: str = "physical") -> list[str]:
    """Static features of the ``physical`` or ``full`` model (the target's own source is never one)."""
    if model == "physical":
        return [c for c in criteria if c in PHYSICAL_FEATURES]
    if model == "full":
        return [c for c in criteria if c != LEAKING_FEATURE]
    raise ValueError(f"unknown model {model!r}")


def training_table(stack: DataFrame, anomalies: DataFrame, severity: DataFrame, features: Sequence[str], *, valid: Sequence[str], cell_filter=None, max_severity: float = 0.0, keep: Sequence[str] = ("row", "col"), label_keys: Sequence[str] = ()) -> DataFrame:
    """Rows of mildly to severely dry years: static features, the year's index, raw anomaly as label.

    ``severity`` is one row per year (and per value of ``label_keys``, which the
    anomalies then carry too); filtering the anomalies by it first lets partition
    pruning skip the other years.
    """
    severity = unique_labels(severity, label_keys)
    years = severity.where(F.col("severity") <= max_severity).select(*label_keys, "year", F.col("severity").alias(DYNAMIC_FEATURE))
    static = stack.where(defined(F.col(v) for v in valid))
    if cell_filter is not None:
        static = static.where(cell_filter)
    return (
        anomalies.where(F.col("anomaly").isNotNull())
        .select(*label_keys, "cell_id", "year", F.col("anomaly").alias("label"))
        .join(years, [*label_keys, "year"])
        .join(static.select("cell_id", *keep, *features), "cell_id")
        .select(*label_keys, "cell_id", "year", *keep, *features, DYNAMIC_FEATURE, "label")
    )


def equal_sample(table: DataFrame, total: int = SAMPLE_SIZE, *, seed: int = 42) -> DataFrame:
    """The same number of rows from every year."""
    years = table.select("year").distinct().count()
    return hash_sample(table, ["year"], total // max(years, 1), ["cell_id"], seed=seed)


def year_weights(table: DataFrame, total: int = SAMPLE_SIZE) -> DataFrame:
    """All rows with a ``weight`` by which years count as in ``equal_sample`` of ``total`` rows."""
    counts = cut_lineage(table.groupBy("year").agg(F.count("*").alias("_n")))
    limit = total // max(counts.count(), 1)
    return table.join(counts, "year").withColumn("weight", F.least(F.lit(1.0), limit / F.col("_n"))).drop("_n")


def tree_share(rows: int, trees: int, size: int = SAMPLE_SIZE) -> float:
    """Share of all rows by which each tree draws some ``size`` of them, but enough that every row is
    drawn three times on average. Where features say nothing, an average over trees that draw
    less adds more noise than it learns, and is worse than the plain mean."""
    return min(1.0, max(size / max(rows, 1), 3 / trees))


def deal_phases(loads: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How ``count`` blocks of one size fall to folds, each to the lightest at its turn.

    Fold f takes its k-th block at load ``loads[f] + k * size``, so the order is a
    merge of progressions with one step: between the starting loads of two folds
    it repeats the same round. Returns (rank of the first block, round of folds)
    of each such phase, and the loads afterwards.
    """
    starts = sorted(set(loads))
    phases, dealt, after = [], 0, list(loads)
    for i, start in enumerate(starts):
        if dealt >= count:
            break
        active = [f for f, load in enumerate(loads) if load <= start]
        first = {f: loads[f] + -(-(start - loads[f]) // size) * size for f in active}
        turn = sorted(active, key=lambda f: (first[f], f))
        room = count - dealt
        if i + 1 < len(starts):
            room = min(room, sum(max(0, -(-(starts[i + 1] - first[f]) // size)) for f in active))
        if room:
            phases.append((dealt, turn))
            for place, f in enumerate(turn):
                after[f] += size * (room // len(turn) + (place < room % len(turn)))
        dealt += room
    return phases, after


def fold_map(table: DataFrame, block: str = "block", *, folds: int = 5) -> DataFrame:
    """``block, fold``: whole blocks, largest first, each to the fold with the fewest rows so far
    (ties: smaller block number, smaller fold).

    The driver sees how many blocks have each size, not the blocks: a block's fold
    follows from its rank among blocks of its size, found by range-wise ranking.
    """
    sizes = cut_lineage(table.groupBy(F.col(block).cast("long").alias("block")).agg(F.count("*").alias("size")))
    histogram = sizes.groupBy("size").agg(F.count("*").alias("blocks")).orderBy(F.desc("size")).collect()
    if sum(r["blocks"] for r in histogram) < folds:
        raise ValueError(f"{sum(r['blocks'] for r in histogram)} blocks cannot fill {folds} folds")
    loads, rows = [0] * folds, []
    for r in histogram:
        phases, loads = deal_phases(loads, r["size"], r["blocks"])
        rows.append((r["size"], [(start, turn) for start, turn in phases]))
    turns = table.sparkSession.createDataFrame(rows, "size long, phases array<struct<start: long, turn: array<int>>>")
    (marks,) = Marks.measure(sizes.select(F.col("block").cast("double").alias("_b")), ["_b"], bucket_count(table))
    numbered = sizes.withColumn("_b", F.col("block").cast("double"))
    ranked = with_rank(numbered, "_b", ["size"], marks, numbered, "block", "_rank").join(turns, "size")
    at = F.col("_rank").cast("long") - 1
    phase = F.element_at(F.filter("phases", lambda p: p["start"] <= at), -1)
    fold = F.element_at(phase["turn"], (F.pmod(at - phase["start"], F.size(phase["turn"])) + 1).cast("int"))
    return ranked.select(F.col("block").alias(block), fold.alias("fold"))


def assign_folds(table: DataFrame, block: str = "block", *, folds: int = 5) -> DataFrame:
    """``table`` with the fold of each row's block (``fold_map``)."""
    return table.join(fold_map(table, block, folds=folds), block)


def forest(features: Sequence[str], *, trees: int = 100, depth: int = 15, min_leaf: int = 5, seed: int = 42) -> RandomForestRegressor:
    """Every split looks at all features, as a regression forest does by default elsewhere."""
    return RandomForestRegressor(trees=trees, depth=depth, min_leaf=min_leaf, seed=seed)


def assemble(table: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(table)


def fit_rows(rows: DataFrame) -> DataFrame:
    """What a fit reads. The ``key`` says how often each tree draws the row."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    return rows.select("features", "label", weight.alias("weight"), F.xxhash64(*[c for c in rows.columns if c != "features"]).alias("key"))


def training_points(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Training rows read once: a fit scans its input twice."""
    points = fit_rows(rows)
    return cut_lineage(points.repartition(tasks, "key") if tasks else points)


def model_path(path: str, fold: int | None = None) -> str:
    """Place of a stored model: the final one, or that of a fold."""
    return f"{path.rstrip('/')}/{'final' if fold is None else f'fold={fold}'}"


def stored_model(path: str, fold: int | None = None) -> RandomForestRegressionModel:
    return RandomForestRegressionModel.load(SparkSession.active(), model_path(path, fold))


def cross_validate(folded: DataFrame, features: Sequence[str], *, folds: int = 5, sample: int | None = None, path: str | None = None, **forest_options) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, mean importances) of blocked cross-validation.

    Each fold's forest is fitted on all rows of the other folds (``year_weights``) and scored on
    all rows of its own; ``sample`` bounds the rows of a fit (``equal_sample``). With ``path``
    every fold's model is stored there, and the stored model does the scoring.
    """
    points = cut_lineage(assemble(folded, features).select("cell_id", "year", "features", "label", "fold"))
    spark = folded.sparkSession

    def fitted(fold: int) -> RandomForestRegressionModel:
        others = points.where(F.col("fold") != fold)
        rows = fit_rows(year_weights(others)) if sample is None else training_points(equal_sample(others, sample), FOLD_TASKS)
        model = forest(features, **forest_options).fit(rows)
        if not path:
            return model
        model.save(spark, model_path(path, fold + 1))
        return RandomForestRegressionModel.load(spark, model_path(path, fold + 1))

    # the driver works between the jobs of a fit, so the folds are fitted side by side
    with ThreadPoolExecutor(folds) as pool:
        models = list(pool.map(inheritable_thread_target(spark)(fitted), range(folds)))
    scored = []
    for fold, model in enumerate(models):
        error = F.col("prediction") - F.col("label")
        scored.append(model.transform(points.where(F.col("fold") == fold)).agg(
            F.lit(fold + 1).alias("fold"), F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("label").alias("var")
        ))
    rows = functools.reduce(DataFrame.unionByName, scored).collect()  # one row per fold, all folds in one job
    metrics = [(r["fold"], r["n"], 1 - r["mse"] / r["var"] if r["var"] else None, r["mse"] ** 0.5, r["mae"]) for r in rows if r["n"]]
    scores = spark.createDataFrame(metrics, "fold int, n long, r2 double, rmse double, mae double")
    mean = [float(sum(column)) / folds for column in zip(*[model.importances for model in models])]
    ranking = spark.createDataFrame(list(zip(features, mean)), "feature string, importance double").orderBy(F.desc("importance"))
    return scores, ranking


def score_spread(scores: DataFrame) -> DataFrame:
    return scores.agg(*[f(m).alias(f"{n}_{m}") for m in ("r2", "rmse", "mae") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def fit_final(table: DataFrame, features: Sequence[str], *, path: str | None = None, draw: int | None = None, **forest_options) -> RandomForestRegressionModel:
    """The forest over all given rows; a column ``weight`` weighs them. Each tree draws as many rows
    as there are, or its share by ``draw`` (``tree_share``). With ``path`` it is stored, and what is
    returned was read back."""
    points = training_points(assemble(table, features))
    model = forest(features, **forest_options)
    if draw is not None:
        model = replace(model, share=tree_share(points.count(), model.trees, draw))
    model = model.fit(points)
    if not path:
        return model
    model.save(table.sparkSession, model_path(path))
    return stored_model(path)


def resilience_gap(model: RandomForestRegressionModel, rows: DataFrame, features: Sequence[str], *, max_severity: float = -1.0) -> DataFrame:
    """Per cell, mean of observed minus expected anomaly over the severe years."""
    severe = rows.where(F.col(DYNAMIC_FEATURE) <= max_severity)
    predicted = model.transform(assemble(severe, features))
    return predicted.groupBy("cell_id").agg(
        F.avg(F.col("label") - F.col("prediction")).alias("resilience_gap"), F.count("*").alias("years")
    )


# --- residual attribution --------------------------------------------------------------


def factor_correlations(df: DataFrame, target: str, factors: Sequence[str], *, min_n: int = 2, **options) -> DataFrame:
    """Rank correlation of the target with every factor, over rows where all are defined."""
    complete = df.where(defined(F.col(c) for c in (target, *factors)))
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    tall = complete.select(F.col(target).alias("y"), F.explode(entries).alias("e")).select("y", "e.factor", "e.x")
    return spearman(tall, "y", "x", groups=["factor"], min_n=min_n, **options)


def quartile_profile(df: DataFrame, target: str, by: str, **options) -> DataFrame:
    """Target statistics per quartile of ``by`` (right-closed), with a 95 % half-width."""
    complete = cut_lineage(df.where(F.col(target).isNotNull() & F.col(by).isNotNull()).select(target, by))
    cuts = column_quantiles(complete, [by], [0.25, 0.5, 0.75], **options)[by]
    quartile = F.when(F.col(by) <= cuts[0], 1).when(F.col(by) <= cuts[1], 2).when(F.col(by) <= cuts[2], 3).otherwise(4)
    marked = complete.withColumn("quartile", quartile)
    split = {f"q{q}": F.when(F.col("quartile") == q, F.col(target)) for q in (1, 2, 3, 4)}
    medians = column_quantiles(marked, split, [0.5], **options)
    median = F.element_at(F.array(*[F.lit(medians[f"q{q}"][0]) for q in (1, 2, 3, 4)]), F.col("quartile"))
    return (
        marked.groupBy("quartile")
        .agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.count("*").alias("n"))
        .select("quartile", "mean", median.alias("median"), "std", "n", (1.96 * F.col("std") / F.sqrt("n")).alias("ci_95"))
    )


def standardized_ols(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """Multiple regression on standardised variables: coefficient, error, t and p per factor.

    Constant factors carry no information and are left out.
    """
    columns = [target, *factors]
    complete = cut_lineage(df.where(defined(F.col(c) for c in columns)).select(*columns))
    head = complete.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).first()
    used = [f for f in factors if head[f"s_{f}"]]
    scaled = complete.select(*[((F.col(c) - head[f"m_{c}"]) / head[f"s_{c}"]).alias(c) for c in (target, *used)])
    points = assemble(scaled.withColumnRenamed(target, "label"), used)
    model = LinearRegression(solver="normal", standardization=False).fit(points)
    summary = model.summary
    # the normal solver lists the intercept last
    coefficients = [*model.coefficients, model.intercept]
    rows = list(zip([*used, "const"], coefficients, summary.coefficientStandardErrors, summary.tValues, summary.pValues))
    return df.sparkSession.createDataFrame(
        [(n, float(c), float(e), float(t), float(p)) for n, c, e, t, p in rows],
        "factor string, coefficient double, std_error double, t_value double, p_value double",
    )
