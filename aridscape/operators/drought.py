"""Standardised precipitation index and drought events over many regions.

Input is one row per region and month. Every window and group carries the
region keys, so the longest group is one region's months.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aridscape.functions import special
from aridscape.functions.columns import correlation, half_open_category, ratio
from aridscape.functions.special import gamma_shape_mle

# Index classes as (exclusive upper bound, label).
SPI_CATEGORIES = [
    (-2.0, "Olağanüstü kurak"),
    (-1.5, "Şiddetli kurak"),
    (-1.0, "Orta kurak"),
    (-0.5, "Hafif kurak"),
    (0.5, "Normale yakın"),
    (1.0, "Hafif nemli"),
    (1.5, "Orta nemli"),
    (2.0, "Çok nemli"),
]
SPI_TOP = "Olağanüstü nemli"
SPI_MISSING = "veri yok"

MIN_CALIBRATION_YEARS = 30
MIN_VALUES = 10
MIN_POSITIVE = 5
PROBABILITY_FLOOR = 1e-6
REGION = ("region_id",)


def accumulate(series: DataFrame, value: str, scale: int, output: str, *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    """Sum of the last ``scale`` defined rows; null until the window is full."""
    if scale < 1:
        raise ValueError(f"scale must be at least one month, got {scale}")
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(scale - 1), 0)
    return series.withColumn(output, F.when(F.count(value).over(window) == scale, F.sum(value).over(window)))


def zero_fraction(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    """Share of dry values per region and calendar month."""
    return (
        series.where(F.col(value).isNotNull())
        .groupBy(*keys, F.month(order).alias("calendar_month"))
        .agg(F.count("*").alias("n"), F.avg((F.col(value) <= 0).cast("double")).alias("zero_fraction"))
    )


@F.pandas_udf(T.DoubleType())
def _shape(s: pd.Series) -> pd.Series:
    values = s.to_numpy("float64")
    out = np.full(values.shape, np.nan)
    usable = np.isfinite(values) & (values > 0)
    if usable.any():
        out[usable] = gamma_shape_mle(values[usable])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _index_value(x: pd.Series, q: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    xv, qv, kv, tv = (c.to_numpy("float64") for c in (x, q, shape, scale))
    out = np.full(xv.shape, np.nan)
    usable = np.isfinite(xv) & np.isfinite(kv)
    if usable.any():
        xs, qs = xv[usable], qv[usable]
        lower = special.gamma_cdf(np.maximum(xs, 0) / tv[usable], kv[usable])
        h = np.where(xs <= 0, qs, qs + (1 - qs) * lower)
        out[usable] = special.normal_quantile(np.clip(h, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR))
    return pd.Series(out)


def gamma_fit(
    series: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = REGION,
    order: str = "month",
    min_values: int = MIN_VALUES,
    min_positive: int = MIN_POSITIVE,
) -> DataFrame:
    """Maximum-likelihood gamma per region and calendar month, location zero.

    Spark reduces each group to count, mean and mean log; only those reach
    Python. Months without enough or with constant positive values get no shape.
    """
    x = F.col(value)
    wet = F.when(x > 0, x)
    stats = (
        series.where(x.isNotNull())
        .groupBy(*keys, F.month(order).alias("calendar_month"))
        .agg(
            F.count("*").alias("n"),
            F.avg((x <= 0).cast("double")).alias("zero_fraction"),
            F.count(wet).alias("n_wet"),
            F.avg(wet).alias("mean_wet"),
            F.avg(F.ln(wet)).alias("mean_log"),
            F.min(wet).alias("least"),
            F.max(wet).alias("most"),
        )
        .where(F.col("n") >= min_values)
    )
    varied = F.col("most") - F.col("least") > 1e-8 + 1e-5 * F.abs("least")
    usable = (F.col("n_wet") >= min_positive) & varied
    s = F.when(usable, F.ln("mean_wet") - F.col("mean_log"))
    return (
        stats.withColumn("shape", _shape(s))
        .withColumn("shape", F.when(usable & ~F.isnan("shape"), F.col("shape")))
        .withColumn("scale", F.col("mean_wet") / F.col("shape"))
        .select(*keys, "calendar_month", "n", "n_wet", "zero_fraction", "shape", "scale")
    )


def calibration_years(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    """Calendar years with a defined value per region; every region of ``series`` has a row."""
    year = F.when(F.col(value).isNotNull(), F.year(order))
    return series.groupBy(*keys).agg(F.size(F.collect_set(year)).cast("long").alias("years"))


def _calibration(series: DataFrame, value: str, scale: int, keys: Sequence[str], order: str, calibration: tuple[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """The accumulated series, and the same with values inside the calibration span only."""
    acc = accumulate(series.where(F.col(value).isNotNull()), value, scale, "_acc", keys=keys, order=order)
    if calibration is None:
        return acc, acc
    inside = F.col(order).between(F.lit(calibration[0]).cast("date"), F.lit(calibration[1]).cast("date"))
    return acc, acc.withColumn("_acc", F.when(inside, F.col("_acc")))


def spi_rejections(
    series: DataFrame, value: str, scale: int, *, keys: Sequence[str] = REGION, order: str = "month",
    calibration: tuple[str, str] | None = None, min_years: int = MIN_CALIBRATION_YEARS,
) -> DataFrame:
    """``keys, years, reason`` of the regions that ``spi`` leaves out."""
    _, base = _calibration(series, value, scale, keys, order, calibration)
    years = calibration_years(base, "_acc", keys=keys, order=order).where(F.col("years") < min_years)
    return years.withColumn("reason", F.concat(F.lit("calibration spans "), F.col("years").cast("string"), F.lit(f" years, at least {min_years} are needed")))


def spi(
    series: DataFrame,
    value: str,
    scale: int,
    *,
    keys: Sequence[str] = REGION,
    order: str = "month",
    calibration: tuple[str, str] | None = None,
    min_years: int = MIN_CALIBRATION_YEARS,
    min_values: int = MIN_VALUES,
    min_positive: int = MIN_POSITIVE,
    output: str = "spi",
) -> DataFrame:
    """Add ``output``: the index at one accumulation scale.

    The distribution is fitted inside the calibration span and applied to the
    whole series. A region with too short a calibration has no rows here and one
    in ``spi_rejections``; the other regions are not touched by it.
    """
    acc, base = _calibration(series, value, scale, keys, order, calibration)
    enough = calibration_years(base, "_acc", keys=keys, order=order).where(F.col("years") >= min_years).select(*keys)
    acc = acc.join(enough, list(keys), "left_semi")
    fit = gamma_fit(base, "_acc", keys=keys, order=order, min_values=min_values, min_positive=min_positive)
    joined = acc.withColumn("calendar_month", F.month(order)).join(
        fit.select(*keys, "calendar_month", "zero_fraction", "shape", "scale"), [*keys, "calendar_month"], "left"
    )
    index = _index_value("_acc", "zero_fraction", "shape", "scale")
    return (
        joined.withColumn(output, index)
        .withColumn(output, F.when(~F.isnan(output), F.col(output)))
        .drop("_acc", "calendar_month", "zero_fraction", "shape", "scale")
    )


def spi_category(value: Column) -> Column:
    return half_open_category(value, SPI_CATEGORIES, SPI_TOP, SPI_MISSING)


def spi_summary(df: DataFrame, value: str = "spi", *, keys: Sequence[str] = REGION) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg((v <= -1.0).cast("double")).alias("drought_share"),
        F.avg((v <= -1.5).cast("double")).alias("severe_share"),
    )


def drought_events(
    df: DataFrame,
    value: str = "spi",
    *,
    threshold: float = -1.0,
    keys: Sequence[str] = REGION,
    order: str = "month",
    break_on_gap: bool = False,
) -> DataFrame:
    """Maximal runs at or below the threshold, most severe first by ``position``.

    Runs follow row order; ``break_on_gap`` also splits where a month is absent.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    dry = F.coalesce(F.col(value) <= threshold, F.lit(False))
    turned = F.coalesce(F.lag("_dry").over(series) != F.col("_dry"), F.lit(True))
    if break_on_gap:
        turned = turned | F.coalesce(F.months_between(order, F.lag(order).over(series)) > 1, F.lit(False))
    runs = (
        df.withColumn("_dry", dry)
        .withColumn("_turned", turned.cast("int"))
        .withColumn("_run", F.sum("_turned").over(series))
        .where("_dry")
        .groupBy(*keys, "_run")
        .agg(
            F.min(order).alias("start"),
            F.max(order).alias("end"),
            F.count("*").alias("months"),
            F.min(value).alias("lowest"),
            F.sum(value).alias("severity"),
        )
        .drop("_run")
    )
    return runs.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("severity", 9), "start")))


def cross_check(df: DataFrame, a: str, b: str, *, keys: Sequence[str] = REGION, min_months: int = 120) -> DataFrame:
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return joint.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.count("*") >= min_months, correlation(F.col(a), F.col(b))).alias("r")
    )


def annual_summary(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    """Yearly total, ratio to the mean year and ascending rank (average rank cut to an integer)."""
    yearly = series.groupBy(*keys, F.year(order).alias("year")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    everything = Window.partitionBy(*keys)
    key = F.round("total", 9)
    by_total = Window.partitionBy(*keys).orderBy("_key")
    peers = Window.partitionBy(*keys, "_key")
    average = F.rank().over(by_total) + (F.count("*").over(peers) - 1) / 2
    return yearly.withColumn("_key", key).select(
        *keys,
        "year",
        F.round("total", 1).alias("total"),
        F.round(ratio(F.col("total"), F.avg("total").over(everything)), 3).alias("ratio_to_mean"),
        average.cast("int").alias("position"),
    )


def driest_years(summary: DataFrame, n: int, *, keys: Sequence[str] = REGION) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("total", "year")
    return summary.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def current_state(df: DataFrame, value: str = "spi", *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    """Last defined value with its month and category."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.col(value), at).alias("value"), F.max(at).alias("month"))
        .withColumn("category", spi_category(F.col("value")))
    )


def monthly_climatology(series: DataFrame, value: str, *, keys: Sequence[str] = REGION, order: str = "month") -> DataFrame:
    return series.groupBy(*keys, F.month(order).alias("calendar_month")).agg(F.avg(value).alias("mean"))


def season_contrast(climatology: DataFrame, *, keys: Sequence[str] = REGION, floor: float = 0.1) -> DataFrame:
    """Mean of the summer (7, 8) and winter (12, 1, 2) months and their ratio."""
    month = F.col("calendar_month")
    out = climatology.groupBy(*keys).agg(
        F.avg(F.when(month.isin(7, 8), F.col("mean"))).alias("summer"),
        F.avg(F.when(month.isin(12, 1, 2), F.col("mean"))).alias("winter"),
    )
    return out.withColumn("winter_to_summer", F.col("winter") / F.greatest("summer", F.lit(floor)))
