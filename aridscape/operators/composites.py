"""Scene observations -> masked reflectance, indices and period composites.

Observations are tall: one row per scene and cell. Masks, scaling and indices
are plain Columns; composites are grouped medians. A median group holds at
most one row per acquisition day of a cell once same-day scenes are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import ratio

# Scene classes that hide the surface.
SCL_MASKED = (0, 1, 3, 7, 8, 9, 10, 11)
# Quality bits fill, dilated cloud, cloud, cloud shadow, snow.
QA_BITS = (0, 1, 3, 4, 5)


def scl_clear(scl: Column, masked: Sequence[int] = SCL_MASKED) -> Column:
    return ~scl.isin(*masked)


def qa_clear(qa: Column, bits: Sequence[int] = QA_BITS) -> Column:
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def baseline_offset(baseline: Column, *, offset: float = -1000.0, since: float = 4.0) -> Column:
    """Radiometric offset of a scene from its processing baseline text."""
    number = baseline.try_cast("double")
    return F.when((number >= since) & ~F.isnan(number), F.lit(offset)).otherwise(F.lit(0.0))


def reflectance(dn: Column, offset: Column, scale: float = 10000.0) -> Column:
    return (dn + offset) / F.lit(float(scale))


def scaled(raw: Column, scale: Column, offset: Column, fill: Column) -> Column:
    """Metadata scaling; fill values are dropped before they could be scaled."""
    return F.when(raw != fill, raw * scale + offset)


def within(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def ndvi(red: Column, nir: Column) -> Column:
    total = nir + red
    return within(F.when(total > 0, (nir - red) / total), -1.0, 1.0)


def evi(red: Column, nir: Column, blue: Column, *, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, soil: float = 1.0) -> Column:
    base = nir + c1 * red - c2 * blue + soil
    return within(F.when(base > 0, gain * (nir - red) / base), -1.0, 1.0)


INDICES = ("ndvi", "evi")


def vegetation_index(name: str, red: Column, nir: Column, blue: Column | None = None) -> Column:
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}, expected one of {INDICES}")
    return ndvi(red, nir) if name == "ndvi" else evi(red, nir, blue)


def same_day_mosaic(obs: DataFrame, bands: Sequence[str], *, cell: Sequence[str] = ("cell_id",), day: str = "day", order: str = "scene_id") -> DataFrame:
    """One row per cell and day: each band from the first scene that has it."""
    return obs.groupBy(*cell, day).agg(
        *[F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands]
    )


def monthly_median(obs: DataFrame, value: str, *, cell: Sequence[str] = ("cell_id",), day: str = "day", output: str = "value") -> DataFrame:
    return obs.groupBy(*cell, F.year(day).alias("year"), F.month(day).alias("month")).agg(F.median(value).alias(output))


def season_median(monthly: DataFrame, months: Sequence[int], value: str = "value", *, by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Unweighted median of the monthly layers of a season."""
    return monthly.where(F.col("month").isin(*months)).groupBy(*by).agg(F.median(value).alias(value))


def modis_celsius(raw: Column, *, low: int = 7500, high: int = 65535, scale: float = 0.02) -> Column:
    return F.when(raw.between(low, high), raw * scale - 273.15)


def landsat_celsius(raw: Column, scale: Column, offset: Column, fill: Column, *, low: float = -20.0, high: float = 75.0) -> Column:
    celsius = scaled(raw, scale, offset, fill) - 273.15
    return F.when((celsius > low) & (celsius < high), celsius)


def season_mean(obs: DataFrame, value: Column, months: Sequence[int], *, by: Sequence[str], day: str = "day", output: str) -> DataFrame:
    return obs.where(F.month(day).isin(*months)).groupBy(*by).agg(F.avg(value).alias(output))


def evaporation_ratio(actual: Column, potential: Column, *, fill: float = 32700, scale: float = 0.1) -> Column:
    """Actual over potential evapotranspiration of one composite."""
    et = F.when(actual < fill, actual * scale)
    pet = F.when(potential < fill, potential * scale)
    return ratio(et, F.when(pet > 1.0, pet))


def seasonal_rain_normal(monthly: DataFrame, value: str, months: Sequence[int], *, cell: Sequence[str] = ("cell_id",), output: str = "precip") -> DataFrame:
    """Mean over years of the season total; a year missing any month is void."""
    clean = F.when(F.col(value) >= 0, F.col(value))
    yearly = (
        monthly.where(F.col("month").isin(*months))
        .groupBy(*cell, "year")
        .agg(F.when(F.count(clean) == len(months), F.sum(clean)).alias("total"))
    )
    return yearly.groupBy(*cell).agg(F.avg("total").alias(output))


def water_capacity(depths: DataFrame, *, cell: Sequence[str] = ("cell_id",), scale: float = 0.001, missing: float = 0.0, output: str = "awc") -> DataFrame:
    """Thickness-weighted field capacity minus wilting point.

    Raw ``missing`` is a gap and a negative difference is a data error; both
    drop the depth, not the cell.
    """
    field = F.when(F.col("field_capacity") != missing, F.col("field_capacity") * scale)
    wilting = F.when(F.col("wilting_point") != missing, F.col("wilting_point") * scale)
    awc = F.when(field - wilting >= 0, field - wilting)
    return (
        depths.withColumn("_awc", awc)
        .groupBy(*cell)
        .agg(
            ratio(
                F.sum(F.col("_awc") * F.col("thickness")),
                F.sum(F.when(F.col("_awc").isNotNull(), F.col("thickness"))),
            ).alias(output)
        )
    )


def clean_elevation(z: Column, *, floor: float = -1000.0) -> Column:
    return F.when(z >= floor, z)


def seasonal_amplitude(monthly: DataFrame, value: str, spring: Sequence[int], dry: Sequence[int], *, by: Sequence[str] = ("cell_id",), output: str = "amplitude") -> DataFrame:
    """Spring peak minus dry-season low."""
    month = F.col("month")
    return monthly.groupBy(*by).agg(
        (F.max(F.when(month.isin(*spring), F.col(value))) - F.min(F.when(month.isin(*dry), F.col(value)))).alias(output)
    )


def month_range(start: int, end: int) -> list[int]:
    """Inclusive months; ranges across the turn of the year are rejected."""
    if not (1 <= start <= 12 and 1 <= end <= 12):
        raise ValueError(f"months must lie in 1..12, got {start}-{end}")
    if end < start:
        raise ValueError(f"month range {start}-{end} crosses the year boundary")
    return list(range(start, end + 1))


def month_bounds(year: Column, month: Column) -> tuple[Column, Column]:
    """First and true last day of a month."""
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)
