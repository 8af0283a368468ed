"""Does the map predict impact? Zonal means, labels, tests and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aridscape.functions.columns import correlation, defined, ratio
from aridscape.functions.special import student_t_two_sided
from aridscape.operators.anomaly import monotone_check
from aridscape.operators.forecast import seasonal_summary, water_year_total
from aridscape.operators.stats import column_quantiles, rank_pairs, stored_spearman
from aridscape.session import cut_lineage

MIN_DRY_YEARS = 3
MIN_EFFECT = 0.10
LABEL_METHODS = ("spring_soil", "wet_season_precip", "summer_spi")


def risk_by_landcover(cells: DataFrame, lookup: DataFrame, risk: str = "risk", *, code: str = "code", min_cells: int = 1000) -> DataFrame:
    """Mean risk per scored class; share of all cells (masked included) and of valid cells."""
    totals = cells.agg(F.count("*").alias("all"), F.count(risk).alias("valid")).first()
    means = (
        cells.where(F.col(risk).isNotNull())
        .groupBy(code)
        .agg(F.avg(risk).alias("mean_risk"), F.count("*").alias("n"))
        .where(F.col("n") >= min_cells)
    )
    return means.join(lookup.where(F.col("score").isNotNull()).select(code, "name"), code).select(
        code, "name", "mean_risk", "n",
        (100.0 * F.col("n") / totals["all"]).alias("share_of_all_pct"),
        (100.0 * F.col("n") / totals["valid"]).alias("share_of_valid_pct"),
    )


def risk_by_elevation(cells: DataFrame, elevation: str, risk: str = "risk", *, bands: int = 5, **options) -> DataFrame:
    """Mean risk in percentile bands of elevation; the last band includes its top."""
    both = cells.where(F.col(elevation).isNotNull() & F.col(risk).isNotNull())
    edges = column_quantiles(both, [elevation], [i / bands for i in range(bands + 1)], **options)[elevation]
    band = F.lit(0)
    for i, low in enumerate(edges[1:-1], start=1):
        band = F.when(F.col(elevation) >= low, i).otherwise(band)
    means = both.groupBy(band.cast("int").alias("band")).agg(F.avg(risk).alias("mean_risk"), F.count("*").alias("n"))
    at = lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("band") + k)
    return means.select("band", at(1).alias("low"), at(2).alias("high"), "mean_risk", "n")


# --- dry-year labels ---------------------------------------------------------------


def _z(yearly: DataFrame, value: str, keys: Sequence[str]) -> Column:
    whole = Window.partitionBy(*keys)
    return ratio(F.col(value) - F.avg(value).over(whole), F.stddev_samp(value).over(whole))


def label_dry_years(series: DataFrame, value: str, *, method: str = "spring_soil", threshold: float = -0.5, keys: Sequence[str] = ("region_id",), order: str = "month") -> DataFrame:
    """``keys, year, severity, is_dry`` from a series the map never saw.

    Standardised over all years of the series, not only the tested ones; a
    year without data is not dry.
    """
    keys = list(keys)
    if method not in LABEL_METHODS:
        raise ValueError(f"unknown label method {method!r}, expected one of {LABEL_METHODS}")
    if method == "summer_spi":
        yearly = seasonal_summary(series, value, (7, 8, 9), keys=keys, order=order, output="_v")
        severity = F.col("_v")
    elif method == "wet_season_precip":
        yearly = water_year_total(series, value, keys=keys, order=order, output="_v")
        severity = _z(yearly, "_v", keys)
    else:
        yearly = seasonal_summary(series, value, (3, 4), keys=keys, order=order, output="_v")
        severity = _z(yearly, "_v", keys)
    return yearly.withColumn("severity", severity).select(
        *keys, "year", "severity", F.coalesce(F.col("severity") <= threshold, F.lit(False)).alias("is_dry")
    )


def severity_index(spi: DataFrame, value: str = "spi", *, months: Sequence[int] = (7, 8, 9), keys: Sequence[str] = ("region_id",), order: str = "month") -> DataFrame:
    """Mean index over the dry season of each year."""
    return seasonal_summary(spi, value, months, keys=keys, order=order, output="severity")


# --- tests -------------------------------------------------------------------------


def cell_subset(landcover: int | None = None, min_irrigation_m: float | None = None, *, code: str = "code", distance: str = "irrigation_m") -> Column:
    """Filter for one land-cover class and/or rain-fed cells."""
    keep = F.lit(True)
    if landcover is not None:
        keep = keep & (F.col(code) == landcover)
    if min_irrigation_m is not None:
        keep = keep & (F.col(distance) >= min_irrigation_m)
    return keep


def yearly_test(joined: DataFrame, labels: DataFrame, *, risk: str = "risk", classes: str = "class", anomaly: str = "anomaly", keys: Sequence[str] = (), label_keys: Sequence[str] = (), min_pairs: int = 100, **options) -> DataFrame:
    """Per year: label, mean anomaly, rank correlation and class monotonicity.

    ``joined`` is the risk table already joined with the anomalies of all
    years; every measure is one grouped pass over it. Land cover or map
    variants go into ``keys``; ``label_keys`` (such as a region) name the rows of
    ``labels`` beside the year and are grouped by as well.
    """
    keys = [*label_keys, *[k for k in keys if k not in label_keys]]
    labels = unique_labels(labels, label_keys)
    by = [*keys, "year"]
    # the join behind the rows is evaluated once; means and ranks scan its result
    rows = cut_lineage(joined.where(F.col(anomaly).isNotNull()).select(*by, F.col(risk).alias("risk"), F.col(classes).alias("class"), F.col(anomaly).alias("anomaly")))
    sums = rows.groupBy(*by, "class").agg(F.sum("anomaly").alias("s"), F.count("*").alias("n"))
    means = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean_anomaly"), F.sum("n").alias("cells"))
    class_means = sums.where(F.col("class") > 0).select(*by, "class", (F.col("s") / F.col("n")).alias("mean"))
    rho = stored_spearman(rank_pairs(rows, "risk", "anomaly", groups=by), groups=by, min_n=min_pairs, **options).select(*by, "rho")
    shape = monotone_check(class_means, keys=by).select(*by, "monotone")
    return (
        means.join(rho, by, "left")
        .join(shape, by, "left")
        .join(labels.select(*label_keys, "year", "severity", "is_dry"), [*label_keys, "year"], "left")
        .withColumn("is_dry", F.coalesce("is_dry", F.lit(False)))
        .select(*by, "severity", "is_dry", "mean_anomaly", "cells", "rho", "monotone")
    )


def unique_labels(labels: DataFrame, label_keys: Sequence[str] = ()) -> DataFrame:
    """``labels``; an error at run time where a year has several rows that
    ``label_keys`` do not tell apart, instead of every region's label on all."""
    by = Window.partitionBy(*label_keys, "year")
    message = f"several labels for one year: name what tells them apart in label_keys (now {list(label_keys)})"
    counted = labels.withColumn("_same", F.count("*").over(by))
    return counted.where(F.when(F.col("_same") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))).drop("_same")


def pooled_class_means(class_means: DataFrame, labels: DataFrame, *, dry_only: bool = True, keys: Sequence[str] = (), label_keys: Sequence[str] = ()) -> DataFrame:
    """Cell-weighted class means over the dry (or all) years of each of ``label_keys``."""
    keys = [*label_keys, *[k for k in keys if k not in label_keys]]
    labels = unique_labels(labels, label_keys)
    wanted = labels.where(F.col("is_dry")) if dry_only else labels
    rows = class_means.join(wanted.select(*label_keys, "year"), [*label_keys, "year"], "left_semi")
    return rows.groupBy(*keys, "class").agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    )


def group_means(yearly: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Years and mean correlation of the dry and the other years."""
    dry = F.col("is_dry")
    return yearly.groupBy(*keys).agg(
        F.sum(dry.cast("long")).alias("n_dry"),
        F.sum((~dry).cast("long")).alias("n_other"),
        F.avg(F.when(dry, F.col("rho"))).alias("dry_rho"),
        F.avg(F.when(~dry, F.col("rho"))).alias("other_rho"),
    )


def verdict(grouped: DataFrame, *, min_dry: int = MIN_DRY_YEARS, min_effect: float = MIN_EFFECT, need_other: bool = False) -> DataFrame:
    """``undecided``, ``not_supported`` or ``supported``; an undefined correlation never supports."""
    few = F.col("n_dry") < min_dry
    if need_other:
        few = few | (F.col("n_other") < 1)
    gap = F.col("other_rho") - F.col("dry_rho")
    return grouped.withColumn("gap", gap).withColumn(
        "verdict",
        F.when(few, "undecided")
        .when(F.col("dry_rho") >= -min_effect, "not_supported")
        .when(gap < min_effect, "not_supported")
        .when(F.col("dry_rho").isNull(), "undecided")
        .otherwise("supported"),
    )


def irrigation_contrast(joined: DataFrame, *, anomaly: str = "anomaly", distance: str = "irrigation_m", near: float = 2000.0, far: float = 10000.0, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Mean anomaly close to and far from irrigation, and the difference."""
    close = F.when(F.col(distance) < near, F.col(anomaly))
    away = F.when(F.col(distance) > far, F.col(anomaly))
    return (
        joined.groupBy(*keys)
        .agg(F.avg(close).alias("near_mean"), F.avg(away).alias("far_mean"), F.count(close).alias("n_near"), F.count(away).alias("n_far"))
        .withColumn("difference", F.col("far_mean") - F.col("near_mean"))
    )


@F.pandas_udf(T.DoubleType())
def _slope_p(r2: pd.Series, n: pd.Series) -> pd.Series:
    dof = (n - 2).astype("float64")
    t = (r2 * dof / (1 - r2).clip(lower=1e-300)) ** 0.5
    return pd.Series(student_t_two_sided(t.to_numpy("float64"), dof.to_numpy("float64")))


def decoupling_trend(yearly: DataFrame, *, keys: Sequence[str] = (), min_years: int = 3, alpha: float = 0.05) -> DataFrame:
    """Straight line of the yearly correlation over the dry years, with its p-value."""
    dry = yearly.where(F.col("is_dry") & F.col("rho").isNotNull())
    year = F.col("year").cast("double")
    fit = dry.groupBy(*keys).agg(
        F.count("*").alias("n_years"),
        F.regr_slope(F.col("rho"), year).alias("slope"),
        F.regr_intercept(F.col("rho"), year).alias("intercept"),
        F.regr_r2(F.col("rho"), year).alias("r_squared"),
    ).where(F.col("n_years") >= min_years)
    return fit.withColumn("p_value", _slope_p("r_squared", "n_years")).withColumn("significant", F.col("p_value") < alpha)


def quality_checks(stack: DataFrame, names: Sequence[str], *, risk: str = "risk", classes: str = "class", directions: Mapping[str, str] | None = None, n_classes: int = 5) -> DataFrame:
    """Pass/fail rows on the produced layers, from one aggregation over the stack.

    ``directions`` maps a raw column to the score it must oppose.
    """
    names = list(names)
    valid = defined(F.col(n) for n in names)
    only_valid = lambda c: F.when(valid, F.col(c))
    checks: list[tuple[str, Column, Column]] = []
    for n in names:
        checks.append((f"unit_range:{n}", F.greatest(-F.min(n), F.max(n) - 1), F.lit(1e-6)))
        checks.append((f"constant:{n}", F.lit(0.01) - F.stddev_pop(n), F.lit(0.0)))
    for a_pos, a in enumerate(names):
        for b in names[a_pos + 1 :]:
            checks.append((f"duplicate:{a}:{b}", F.abs(correlation(only_valid(a), only_valid(b))), F.lit(0.97)))
    checks.append(("coverage", F.lit(0.9) - F.avg(valid.cast("double")), F.lit(0.0)))
    checks.append(("risk_range", F.greatest(-F.min(risk), F.max(risk) - 1), F.lit(0.0)))
    checks.append(("risk_span", F.lit(0.3) - (F.max(risk) - F.min(risk)), F.lit(0.0)))
    total = F.sum((F.col(classes) > 0).cast("double"))
    for code in range(1, n_classes + 1):
        share = F.sum((F.col(classes) == code).cast("double")) / total
        checks.append((f"class_share:{code}", F.abs(share - 0.26) - 0.24, F.lit(0.0)))
    for raw, score in (directions or {}).items():
        checks.append((f"direction:{raw}", correlation(F.col(raw), F.col(score)) + 0.9, F.lit(0.0)))
    rows = [F.struct(F.lit(n).alias("check"), v.cast("double").alias("measure"), limit.alias("limit")) for n, v, limit in checks]
    return (
        stack.agg(F.array(*rows).alias("r"))
        .select(F.inline("r"))
        .withColumn("passed", F.coalesce(F.col("measure") <= F.col("limit"), F.lit(False)))
    )
