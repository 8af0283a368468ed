"""Crop yield from production and area, with quality checks and anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aridscape.functions.columns import ratio

# Plausible yield per crop in t/ha.
YIELD_LIMITS = {"tahil": (0.5, 8.0), "pamuk_lifi": (0.3, 3.0), "uzum": (2.0, 40.0), "zeytin": (0.5, 20.0)}
MIN_YEARS = 10
RESIDUAL_FLOOR = 0.02


def area_with_fallback(primary: DataFrame, fallback: DataFrame, *, keys: Sequence[str] = ("crop", "year")) -> DataFrame:
    """Primary area, else the fallback statistic of the same crop and year."""
    spare = fallback.select(*keys, F.col("area").alias("_spare"))
    return primary.join(spare, list(keys), "left").withColumn("area", F.coalesce("area", "_spare")).drop("_spare")


def checked_yield(table: DataFrame, *, limits: Mapping[str, tuple[float, float]] = YIELD_LIMITS, crop: str = "crop") -> DataFrame:
    """Add ``yield_t_ha`` and ``reason`` (why an observation was rejected, else null)."""
    low = F.lit(0.0)
    high = F.lit(float("inf"))
    for name, (a, b) in limits.items():
        low = F.when(F.col(crop) == name, float(a)).otherwise(low)
        high = F.when(F.col(crop) == name, float(b)).otherwise(high)
    raw = ratio(F.col("production"), F.col("area"))
    reason = F.when(F.col("production") == F.col("area"), "production equals area").when(
        (raw < low) | (raw > high), "outside plausible range"
    )
    return table.withColumn("_raw", raw).withColumn("reason", reason).withColumn("yield_t_ha", F.when(F.col("reason").isNull(), F.col("_raw"))).drop("_raw")


def kept(checked: DataFrame) -> DataFrame:
    """Observations with a yield; empty years and crops vanish by themselves."""
    return checked.where(F.col("yield_t_ha").isNotNull())


def rejections(checked: DataFrame, *, crop: str = "crop", year: str = "year") -> DataFrame:
    """Reason -> rejected observations. One row per crop, so a list holds one crop's years."""
    tag = F.col(year).cast("string")
    return (
        checked.where(F.col("reason").isNotNull())
        .groupBy("reason", crop)
        .agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(tag))).alias("years"))
    )


def detrended_anomaly(
    yields: DataFrame, *, value: str = "yield_t_ha", keys: Sequence[str] = ("crop",), year: str = "year",
    min_years: int = MIN_YEARS, detrend: bool = True, residual_floor: float = RESIDUAL_FLOOR,
) -> DataFrame:
    """z of the residual around each crop's linear trend.

    Crops with too few years drop out; where the trend explains practically
    everything the anomaly is undefined and drops out too.
    """
    rows = yields.where(F.col(value).isNotNull())
    x, y = F.col(year).cast("double"), F.col(value)
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.regr_slope(y, x).alias("_slope"), F.stddev_samp(y).alias("_raw_std"),
    ).where(F.col("_n") >= min_years)
    slope = F.col("_slope") if detrend else F.lit(0.0)
    residual = y - F.col("_my") - slope * (x - F.col("_mx"))
    with_residual = rows.join(fit, list(keys)).withColumn("residual", residual)
    whole = Window.partitionBy(*keys)
    spread = F.stddev_samp("residual").over(whole)
    return (
        with_residual.withColumn("_std", spread)
        .where(F.col("_std") >= residual_floor * F.greatest("_raw_std", F.lit(1e-12)))
        .withColumn("anomaly", (F.col("residual") - F.avg("residual").over(whole)) / F.col("_std"))
        .select(*keys, year, value, "residual", "anomaly")
    )
