"""Leave-one-out anomalies of yearly layers and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.functions.columns import half_open_category

# Anomaly classes as (exclusive upper bound, label).
ANOMALY_CATEGORIES = [
    (-2.0, "Olağanüstü altında"),
    (-1.5, "Şiddetli altında"),
    (-1.0, "Orta altında"),
    (-0.5, "Hafif altında"),
    (0.5, "Normale yakın"),
    (1.0, "Hafif üstünde"),
]
ANOMALY_TOP = "Belirgin üstünde"

MIN_BASELINE_YEARS = 5
MIN_LONG_BASELINE_YEARS = 10
MIN_BASELINE_STD = 0.01

# Sign that turns each impact source into "low means damage".
IMPACT_SIGNS = {"ndvi": 1, "et": 1, "lst": -1}


def yearly_season(monthly: DataFrame, months: Sequence[int], value: str = "value", *, cell: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Median of a year's season months; missing months are tolerated."""
    return monthly.where(F.col("month").isin(*months)).groupBy(*cell, "year").agg(F.median(value).alias(value))


def require_years(layers: DataFrame, min_baseline: int, *, year: str = "year") -> int:
    """Number of years present; each target year needs ``min_baseline`` others."""
    years = layers.select(year).distinct().count()
    if years - 1 < min_baseline:
        raise ValueError(f"baseline has {max(years - 1, 0)} years, at least {min_baseline} are needed")
    return years


def signed(layers: DataFrame, source: str, value: str = "value", *, signs: Mapping[str, int] = IMPACT_SIGNS) -> DataFrame:
    """Orient a source so that low always means damage."""
    if source not in signs:
        raise KeyError(f"unknown impact source {source!r}, expected one of {sorted(signs)}")
    return layers.withColumn(value, F.col(value) * F.lit(signs[source]))


def leave_one_out(
    layers: DataFrame,
    value: str = "value",
    *,
    cell: Sequence[str] = ("cell_id",),
    standardize: bool = True,
    min_std: float = MIN_BASELINE_STD,
    output: str = "anomaly",
) -> DataFrame:
    """Deviation of every year from the mean of the other years, all years at once.

    Sums over a cell's years give the other years' mean and sample deviation by
    subtraction, so the cost is linear in the years. Values are first centred
    on the cell mean, otherwise the squares would cancel. Adds the baseline
    standard deviation and an ``unstable`` flag.
    """
    years = Window.partitionBy(*cell)
    centred = layers.withColumn("_c", F.col(value) - F.avg(value).over(years)).withColumns(
        {
            "_n": F.count(value).over(years),
            "_s": F.sum("_c").over(years),
            "_q": F.sum(F.col("_c") * F.col("_c")).over(years),
        }
    )
    c = F.coalesce(F.col("_c"), F.lit(0.0))
    n = F.col("_n") - F.when(F.col("_c").isNotNull(), 1).otherwise(0)
    mean = F.try_divide(F.col("_s") - c, n)
    rest = F.col("_q") - c * c - n * mean * mean
    std = F.when(n > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / F.greatest(n - 1, F.lit(1))))
    difference = F.col("_c") - mean
    unstable = F.coalesce(~(std > min_std), F.lit(True)) if standardize else F.lit(False)
    result = F.when(~unstable, difference / std) if standardize else difference
    return (
        centred.withColumns({"_std": std, "_mean": mean})
        .withColumn("unstable", unstable)
        .withColumn(output, result)
        .withColumn("baseline_std", F.col("_std"))
        .drop("_c", "_n", "_s", "_q", "_std", "_mean")
    )


def mask_report(anomalies: DataFrame, anomaly: str = "anomaly", *, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Share of undefined cells and of cells with an unstable baseline (among those with a deviation)."""
    return anomalies.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.avg(F.col(anomaly).isNull().cast("double")).alias("masked_share"),
        F.coalesce(F.avg(F.when(F.col("baseline_std").isNotNull(), F.col("unstable").cast("double"))), F.lit(0.0)).alias("unstable_share"),
    )


def anomaly_category(value: Column) -> Column:
    return half_open_category(value, ANOMALY_CATEGORIES, ANOMALY_TOP, None)


def class_shares(anomalies: DataFrame, anomaly: str = "anomaly", *, keys: Sequence[str] = ("year",)) -> DataFrame:
    counted = (
        anomalies.where(F.col(anomaly).isNotNull())
        .groupBy(*keys, anomaly_category(F.col(anomaly)).alias("category"))
        .agg(F.count("*").alias("n"))
    )
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def by_landcover(anomalies: DataFrame, lookup: DataFrame, anomaly: str = "anomaly", *, keys: Sequence[str] = ("year",), code: str = "code", min_cells: int = 1000) -> DataFrame:
    """Mean anomaly of each scored land-cover class with enough cells.

    Grouped on the code first: the names join a handful of result rows.
    """
    means = (
        anomalies.where(F.col(anomaly).isNotNull())
        .groupBy(*keys, code)
        .agg(F.avg(anomaly).alias("mean"), F.count("*").alias("n"))
        .where(F.col("n") >= min_cells)
    )
    return means.join(lookup.where(F.col("score").isNotNull()).select(code, "name"), code)


def by_class(df: DataFrame, value: str, class_column: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and count of the defined values per class 1..k."""
    return (
        df.where(F.col(value).isNotNull() & (F.col(class_column) > 0))
        .groupBy(*keys, F.col(class_column).alias("class"))
        .agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    )


def monotone_check(class_means: DataFrame, *, keys: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """Per group: do class means never rise, and is the last class below the first?

    A group is a handful of class rows.
    """
    order = Window.partitionBy(*keys).orderBy("class")
    mean = F.round("mean", digits)
    step = class_means.withColumn("_ok", F.coalesce(F.lag(mean).over(order) >= mean, F.lit(True)))
    return step.groupBy(*keys).agg(
        F.bool_and("_ok").alias("monotone"),
        (F.max_by("mean", "class") < F.min_by("mean", "class")).alias("extremes_ordered"),
    )


def class_month_curve(samples: DataFrame, monthly: DataFrame, class_column: str, *, size: int = 3, value: str = "value") -> DataFrame:
    """Per class and month, the mean of the sampled cells' window means.

    ``samples`` holds ``row, col`` and the class, ``monthly`` holds ``row, col,
    month`` and the value. Only the samples' neighbourhoods are looked up; the
    layers are scanned once and never gridded.
    """
    half = size // 2
    offsets = F.sequence(F.lit(-half), F.lit(half))
    around = (
        samples.select(class_column, F.col("row").alias("_r"), F.col("col").alias("_c"))
        .withColumn("_dr", F.explode(offsets))
        .withColumn("_dc", F.explode(offsets))
        .withColumns({"row": F.col("_r") + F.col("_dr"), "col": F.col("_c") + F.col("_dc")})
        .drop("_dr", "_dc")
    )
    focal = (
        monthly.where(F.col(value).isNotNull())
        .join(around, ["row", "col"])
        .groupBy(class_column, "_r", "_c", "month")
        .agg(F.avg(value).alias("focal"))
    )
    return focal.groupBy(class_column, "month").agg(F.avg("focal").alias("mean"), F.count("*").alias("n"))
