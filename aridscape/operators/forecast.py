"""Forecast baselines, skill scores and seasonal prediction for many regions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aridscape.functions.columns import correlation, ratio
from aridscape.operators.keyed import by_keys
from aridscape.operators.stats import spearman
from aridscape.session import cut_lineage

REGION = ("region_id",)
WET_MONTHS = (11, 12, 1, 2, 3, 4)
METHODS = ("climatology", "persistence", "damped_persistence")


def _numbered(series: DataFrame, value: str, keys: Sequence[str], order: str, train_fraction: float) -> DataFrame:
    if not 0.3 <= train_fraction <= 0.9:
        raise ValueError(f"train_fraction must lie in 0.3..0.9, got {train_fraction}")
    whole = Window.partitionBy(*keys)
    return (
        series.where(F.col(value).isNotNull())
        .withColumn("t", F.row_number().over(whole.orderBy(order)))
        .withColumn("n_total", F.count("*").over(whole))
        .withColumn("cut", F.floor(F.col("n_total") * F.lit(train_fraction)).cast("int"))
    )


def chronological_split(
    series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month", train_fraction: float = 0.7, min_rows: int = 24
) -> DataFrame:
    """Defined rows with their position ``t``, the cut and ``is_train``; never random.

    Regions of which either part falls below ``min_rows`` have no rows here, but
    one in ``split_rejections``.
    """
    numbered = _numbered(series, value, keys, order, train_fraction)
    enough = (F.col("cut") >= min_rows) & (F.col("n_total") - F.col("cut") >= min_rows)
    return numbered.where(enough).withColumn("is_train", F.col("t") <= F.col("cut")).drop("n_total")


def split_rejections(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, train_fraction: float = 0.7, min_train: int = 24, min_test: int = 24) -> DataFrame:
    """``keys, n_train, n_test, reason`` of the regions too short to be split, from one aggregation."""
    n = F.count(value)
    cut = F.floor(n * F.lit(train_fraction)).cast("long")
    counts = series.groupBy(*keys).agg(cut.alias("n_train"), (n - cut).alias("n_test"))
    short = counts.where((F.col("n_train") < min_train) | (F.col("n_test") < min_test))
    parts = (F.lit("too few rows after the split: train "), F.col("n_train").cast("string"), F.lit(", test "), F.col("n_test").cast("string"), F.lit(f", needed {min_train} and {min_test}"))
    return short.withColumn("reason", F.concat(*parts))


def lagged(df: DataFrame, value: str, lead: int, *, keys: Sequence[str] = REGION, order: str = "month") -> Column:
    """Persistence: the value ``lead`` rows back."""
    if lead < 1:
        raise ValueError(f"lead must be at least one, got {lead}")
    return F.lag(value, lead).over(Window.partitionBy(*keys).orderBy(order))


def lag_correlation(train: DataFrame, value: str, lead: int, *, keys: Sequence[str] = REGION, order: str = "month", min_pairs: int = 12) -> DataFrame:
    pairs = train.withColumn("_lag", lagged(train, value, lead, keys=keys, order=order))
    n = F.count("_lag")
    return pairs.groupBy(*keys).agg(F.when(n >= min_pairs, correlation(F.col(value), F.col("_lag"))).otherwise(0.0).alias("rho"))


def skill(
    scored: DataFrame, truth: str, prediction: str, persistence: str, *, keys: Sequence[str], drought: float = -1.0
) -> DataFrame:
    """Verification scores per key from rows with truth and prediction.

    ``persistence`` is the truth ``lead`` rows back inside the scored slice
    only, so its first rows are null and leave the reference error.
    """
    y, p, ref = F.col(truth), F.col(prediction), F.col(persistence)
    rows = scored.where(y.isNotNull() & p.isNotNull())
    hit = (p <= drought) & (y <= drought)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        correlation(y, p).alias("_r"),
        F.stddev_pop(p).alias("_sp"),
        F.avg((p - y) * (p - y)).alias("_mse"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.avg(y * y).alias("_clim"),
        F.avg((ref - y) * (ref - y)).alias("_pers"),
        F.sum(hit.cast("long")).alias("_hits"),
        F.sum((y <= drought).cast("long")).alias("_actual"),
        F.sum((p <= drought).cast("long")).alias("_predicted"),
    )
    against = lambda base: F.when(F.col(base) > 0, F.lit(1.0) - F.col("_mse") / F.col(base))
    return sums.select(
        *keys,
        "n",
        F.when(F.col("_sp") > 0, F.col("_r")).otherwise(0.0).alias("correlation"),
        F.sqrt("_mse").alias("rmse"),
        "mae",
        against("_clim").alias("skill_vs_climatology"),
        against("_pers").alias("skill_vs_persistence"),
        ratio(F.col("_hits").cast("double"), F.col("_actual").cast("double")).alias("hit_rate"),
        ratio((F.col("_predicted") - F.col("_hits")).cast("double"), F.col("_predicted").cast("double")).alias("false_alarm_ratio"),
    )


def benchmark(
    series: DataFrame,
    value: str,
    *,
    leads: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = REGION,
    order: str = "month",
    train_fraction: float = 0.7,
    drought: float = -1.0,
    min_rows: int = 24,
    min_pairs: int = 12,
) -> DataFrame:
    """All methods at all leads, learned on the first part, scored on the rest.

    One window pass makes the lags; leads and methods are exploded from each
    row, so the whole matrix is one aggregation.
    """
    keys = list(keys)
    split = chronological_split(series, value, keys=keys, order=order, train_fraction=train_fraction, min_rows=min_rows)
    lags = F.array(*[F.struct(F.lit(h).alias("lead"), lagged(split, value, h, keys=keys, order=order).alias("lag")) for h in leads])
    tall = split.withColumn("l", lags).select(
        *keys, F.col(value).alias("truth"), "t", "cut", "is_train", F.explode("l").alias("l")
    ).select(*keys, "truth", "t", "cut", "is_train", "l.lead", "l.lag")
    pair = F.col("is_train") & F.col("lag").isNotNull()
    n_pairs = F.sum(pair.cast("long"))
    rho = tall.groupBy(*keys, "lead").agg(
        F.when(n_pairs >= min_pairs, correlation(F.when(pair, F.col("truth")), F.when(pair, F.col("lag")))).otherwise(0.0).alias("rho")
    )
    test = tall.where(~F.col("is_train")).join(rho, [*keys, "lead"])
    methods = F.array(
        F.struct(F.lit(METHODS[0]).alias("method"), F.lit(0.0).alias("pred")),
        F.struct(F.lit(METHODS[1]).alias("method"), F.col("lag").alias("pred")),
        F.struct(F.lit(METHODS[2]).alias("method"), (F.col("lag") * F.col("rho")).alias("pred")),
    )
    inside = F.when(F.col("t") > F.col("cut") + F.col("lead"), F.col("lag"))
    rows = test.select(*keys, "lead", "truth", inside.alias("persist"), F.explode(methods).alias("m")).select(
        *keys, "lead", "truth", "persist", "m.method", "m.pred"
    )
    return skill(rows, "truth", "pred", "persist", keys=[*keys, "method", "lead"], drought=drought)


# --- seasonal ---------------------------------------------------------------------


def seasonal_summary(series: DataFrame, value: str, months: Sequence[int], *, how: str = "mean", keys: Sequence[str] = REGION, order: str = "month", output: str | None = None) -> DataFrame:
    """Mean or sum over chosen months of each year."""
    if how not in ("mean", "sum"):
        raise ValueError(f"how must be mean or sum, got {how!r}")
    aggregate = F.avg(value) if how == "mean" else F.sum(value)
    return series.where(F.month(order).isin(*months)).groupBy(*keys, F.year(order).alias("year")).agg(aggregate.alias(output or value))


def water_year(order: str = "month") -> Column:
    """November and December feed the next year."""
    return F.year(order) + F.when(F.month(order) >= 11, 1).otherwise(0)


def water_year_total(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month", months: Sequence[int] = WET_MONTHS, output: str = "wet_season") -> DataFrame:
    return series.where(F.month(order).isin(*months)).groupBy(*keys, water_year(order).alias("year")).agg(F.sum(value).alias(output))


PREDICTORS = ("wet_season_ppt", "spring_ppt", "spring_soil", "spring_pdsi", "spring_pet")


def seasonal_dataset(
    series: DataFrame,
    *,
    predictor_months: Sequence[int] = (3, 4),
    target_months: Sequence[int] = (7, 8, 9),
    target: str = "soil",
    keys: Sequence[str] = REGION,
    order: str = "month",
) -> DataFrame:
    """Yearly predictors known in spring beside the summer target.

    A month belongs to a calendar year and a water year; both contributions
    are exploded from the row, so all predictors and the target come out of
    one aggregation instead of five joins on the year.
    """
    overlap = set(predictor_months) & set(target_months)
    if overlap:
        raise ValueError(f"predictor and target months overlap: {sorted(overlap)}")
    if max(predictor_months) >= min(target_months):
        raise ValueError(f"predictor months {predictor_months} must end before the target {target_months}")
    if target not in series.columns:
        raise KeyError(f"target column {target!r} is not in {series.columns}")
    month = F.month(order)
    placed = series.withColumn(
        "_y",
        F.explode(
            F.array_distinct(F.array(F.year(order), water_year(order)))
        ),
    )
    calendar = F.col("_y") == F.year(order)
    spring = calendar & month.isin(*predictor_months)
    wet = (F.col("_y") == water_year(order)) & month.isin(*WET_MONTHS)
    summer = calendar & month.isin(*target_months)
    measures = {
        "wet_season_ppt": ("ppt", F.sum, wet),
        "spring_ppt": ("ppt", F.sum, spring),
        "spring_soil": ("soil", F.avg, spring),
        "spring_pdsi": ("pdsi", F.avg, spring),
        "spring_pet": ("pet", F.sum, spring),
    }
    chosen = {n: f(F.when(cond, F.col(c))).alias(n) for n, (c, f, cond) in measures.items() if c in series.columns}
    table = placed.groupBy(*keys, F.col("_y").alias("year")).agg(
        *chosen.values(), F.avg(F.when(summer, F.col(target))).alias("target"), F.max(F.when(summer, 1)).alias("_has_target")
    )
    return table.where((F.col("_has_target") == 1) & F.coalesce(*[F.col(n).cast("double") for n in chosen]).isNotNull()).drop("_has_target")


def describe_predictors(dataset: DataFrame, predictors: Sequence[str] = PREDICTORS, *, keys: Sequence[str] = REGION, **options) -> DataFrame:
    """Pearson and Spearman of every predictor with the target."""
    entries = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors])
    tall = dataset.select(*keys, "target", F.explode(entries).alias("e")).select(*keys, "target", "e.predictor", "e.x")
    joint = tall.where(F.col("x").isNotNull() & F.col("target").isNotNull())
    pearson = joint.groupBy(*keys, "predictor").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("target")).alias("pearson"))
    rank = spearman(joint, "x", "target", groups=[*keys, "predictor"], min_n=2, **options)
    return pearson.join(rank.select(*keys, "predictor", F.col("rho").alias("spearman")), [*keys, "predictor"])


def _seasonal_split(dataset: DataFrame, keys: Sequence[str], train_fraction: float, min_train: int, min_test: int) -> DataFrame:
    """Years with a target, their position, the previous target and the training mean,
    of the regions long enough (see ``split_rejections`` for the others)."""
    whole = Window.partitionBy(*keys)
    years = whole.orderBy("year")
    split = (
        dataset.where(F.col("target").isNotNull())
        .withColumns(
            {
                "t": F.row_number().over(years),
                "cut": F.floor(F.count("*").over(whole) * F.lit(train_fraction)).cast("int"),
                "n_total": F.count("*").over(whole),
                "previous": F.lag("target").over(years),
            }
        )
        .withColumn("is_train", F.col("t") <= F.col("cut"))
        .withColumn("train_mean", F.avg(F.when(F.col("is_train"), F.col("target"))).over(whole))
    )
    enough = (F.col("cut") >= min_train) & (F.col("n_total") - F.col("cut") >= min_test)
    return split.where(enough).drop("n_total")


def seasonal_baselines(dataset: DataFrame, *, keys: Sequence[str] = REGION, train_fraction: float = 0.7, min_train: int = 15, min_test: int = 10) -> DataFrame:
    """Training-mean climatology and last-year persistence on the test years."""
    keys = list(keys)
    test = _seasonal_split(dataset, keys, train_fraction, min_train, min_test).where(~F.col("is_train"))
    y, prev, mean = F.col("target"), F.col("previous"), F.col("train_mean")
    sums = test.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(prev).alias("np"),
        F.avg((y - mean) * (y - mean)).alias("mc"),
        F.avg((y - prev) * (y - prev)).alias("mp"),
        correlation(F.col("target"), F.col("previous")).alias("rp"),
    )
    rows = F.array(
        F.struct(
            F.lit("climatology").alias("method"), F.col("n").alias("n_test"), F.lit(0.0).alias("correlation"),
            F.sqrt("mc").alias("rmse"), F.lit(0.0).alias("skill_vs_climatology"),
            (F.lit(1.0) - ratio(F.col("mc"), F.col("mp"))).alias("skill_vs_persistence"),
        ),
        F.struct(
            F.lit("persistence").alias("method"), F.col("np").alias("n_test"), F.col("rp").alias("correlation"),
            F.sqrt("mp").alias("rmse"), (F.lit(1.0) - ratio(F.col("mp"), F.col("mc"))).alias("skill_vs_climatology"),
            F.lit(0.0).alias("skill_vs_persistence"),
        ),
    )
    return sums.select(*keys, F.inline(rows))


def univariate_skill(
    dataset: DataFrame, predictors: Sequence[str] = PREDICTORS, *, keys: Sequence[str] = REGION, train_fraction: float = 0.7,
    min_train: int = 15, min_test: int = 10, min_fit: int = 15, min_score: int = 8,
) -> DataFrame:
    """One straight line per predictor, fitted on training years, scored on test years."""
    keys = list(keys)
    split = _seasonal_split(dataset, keys, train_fraction, min_train, min_test)
    reference = split.where(~F.col("is_train")).groupBy(*keys).agg(
        F.avg((F.col("target") - F.col("previous")) * (F.col("target") - F.col("previous"))).alias("mp")
    )
    entries = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors])
    tall = (
        split.select(*keys, "target", "is_train", "train_mean", F.explode(entries).alias("e"))
        .select(*keys, "target", "is_train", "train_mean", "e.predictor", "e.x")
        .where(F.col("x").isNotNull())
    )
    y = F.when(F.col("is_train"), F.col("target"))
    x = F.when(F.col("is_train"), F.col("x"))
    fit = tall.groupBy(*keys, "predictor").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.count(y).alias("n_train"), F.sum((~F.col("is_train")).cast("long")).alias("n_test"),
    ).where((F.col("n_train") >= min_fit) & (F.col("n_test") >= min_score))
    prediction = F.col("slope") * F.col("x") + F.col("intercept")
    error = F.col("target") - prediction
    anomaly = F.col("target") - F.col("train_mean")
    scored = (
        tall.where(~F.col("is_train")).join(fit, [*keys, "predictor"]).withColumn("p", prediction)
        .groupBy(*keys, "predictor", "slope", "intercept")
        .agg(
            F.count("*").alias("n_test"), correlation(F.col("target"), F.col("p")).alias("correlation"),
            F.avg(error * error).alias("mse"), F.avg(anomaly * anomaly).alias("mc"),
        )
        .join(reference, keys)
    )
    return scored.select(
        *keys, "predictor", "n_test", "slope", "intercept", "correlation", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - ratio(F.col("mse"), F.col("mc"))).alias("skill_vs_climatology"),
        (F.lit(1.0) - ratio(F.col("mse"), F.col("mp"))).alias("skill_vs_persistence"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(products: pd.Series, right: pd.Series) -> pd.Series:
    """Solutions of a batch of symmetric systems, given as rows of the upper triangle."""
    if not len(right):
        return pd.Series([], dtype=object)
    rhs = np.stack(right.to_numpy())
    size = rhs.shape[1]
    matrix = np.zeros((len(rhs), size, size))
    i, j = np.triu_indices(size)
    matrix[:, i, j] = matrix[:, j, i] = np.stack(products.to_numpy())
    return pd.Series(list(np.linalg.solve(matrix, rhs[:, :, None])[:, :, 0]))


def ridge_fit(train: DataFrame, predictors: Sequence[str], *, keys: Sequence[str] = REGION, alpha: float = 1.0) -> DataFrame:
    """``keys, n_train, intercept, centre, spread, coefficients`` (arrays over the predictors).

    Inputs are standardised by the population deviation (a constant one counts
    as zero), the target is centred, and squared coefficients cost ``alpha``. Each
    region is reduced to its sums of products, and small systems are solved batchwise.
    """
    keys, k = list(keys), len(predictors)
    stats = train.groupBy(*keys).agg(
        F.count("*").alias("n_train"), F.avg("target").alias("intercept"),
        F.array(*[F.avg(p).cast("double") for p in predictors]).alias("centre"), F.array(*[F.stddev_pop(p).cast("double") for p in predictors]).alias("spread"),
    )
    met = by_keys(train.select(*keys, "target", *predictors), stats, keys)
    z = [_standardised(p, i) for i, p in enumerate(predictors)]
    y = F.col("target") - F.col("intercept")
    pairs = [F.sum(z[i] * z[j]) + F.lit(float(alpha) if i == j else 0.0) for i in range(k) for j in range(i, k)]
    sums = met.groupBy(*keys).agg(F.array(*pairs).alias("_a"), F.array(*[F.sum(c * y) for c in z]).alias("_b"))
    solved = sums.select(*keys, _solved("_a", "_b").alias("coefficients"))
    return by_keys(stats, solved, keys)


def _standardised(predictor: str, i: int) -> Column:
    return F.coalesce(ratio(F.col(predictor) - F.col("centre")[i], F.col("spread")[i]), F.lit(0.0))


def ridge_skill(
    dataset: DataFrame, predictors: Sequence[str] = PREDICTORS, *, keys: Sequence[str] = REGION, alpha: float = 1.0, train_fraction: float = 0.7,
    min_train: int = 15, min_test: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Standardised ridge on all predictors, for every region at once.

    Returns one skill row per region, beside those of the other seasonal
    methods, and ``keys, predictor, coefficient`` on standardised inputs. Years
    without one of the predictors take no part.
    """
    keys = list(keys)
    split = _seasonal_split(dataset, keys, train_fraction, min_train, min_test)
    complete = split.where(functools.reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in predictors]))
    fit = cut_lineage(ridge_fit(complete.where("is_train"), predictors, keys=keys, alpha=alpha))
    prediction = sum((F.col("coefficients")[i] * _standardised(p, i) for i, p in enumerate(predictors)), F.col("intercept"))
    scored = by_keys(complete.where(~F.col("is_train")), fit, keys).withColumn("p", prediction)
    y, p, prev, mean = F.col("target"), F.col("p"), F.col("previous"), F.col("train_mean")
    skills = scored.groupBy(*keys, "n_train").agg(
        F.count("*").alias("n_test"), correlation(F.col("target"), F.col("p")).alias("correlation"),
        F.avg((y - p) * (y - p)).alias("mse"), F.avg((y - mean) * (y - mean)).alias("mc"), F.avg((y - prev) * (y - prev)).alias("mp"),
    ).select(
        *keys, "n_train", "n_test", "correlation", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - ratio(F.col("mse"), F.col("mc"))).alias("skill_vs_climatology"),
        (F.lit(1.0) - ratio(F.col("mse"), F.col("mp"))).alias("skill_vs_persistence"),
    )
    names = F.array(*[F.lit(p) for p in predictors])
    coefficients = fit.select(*keys, F.inline(F.arrays_zip(names.alias("predictor"), F.col("coefficients").alias("coefficient"))))
    return skills, coefficients.toDF(*keys, "predictor", "coefficient")


def best_predictor(skills: DataFrame, *, keys: Sequence[str] = REGION) -> DataFrame:
    """Per region the predictor beating both baselines with the largest gain."""
    useful = skills.where((F.col("skill_vs_climatology") > 0) & (F.col("skill_vs_persistence") > 0))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("skill_vs_climatology", 9)), "predictor")
    return useful.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
