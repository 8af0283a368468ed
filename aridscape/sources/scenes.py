"""Scene catalogue: selection, relaxation and quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENE_SCHEMA = T.StructType(
    [
        T.StructField("scene_id", T.StringType(), False),
        T.StructField("collection", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("cloud", T.DoubleType()),
        T.StructField("west", T.DoubleType()),
        T.StructField("south", T.DoubleType()),
        T.StructField("east", T.DoubleType()),
        T.StructField("north", T.DoubleType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "bands",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField(n, T.DoubleType()) for n in ("scale", "offset", "nodata")]),
            ),
        ),
    ]
)

PLATFORMS = ("MYD11A2", "MOD11A2", "both")


def select_scenes(scenes: DataFrame, *, collection: str | None = None, bbox: Sequence[float] | None = None, start=None, end=None, max_cloud: float | None = None) -> DataFrame:
    """Plain predicates, so a stored catalogue is pruned by partition and statistics. Cloud limit is exclusive, dates are whole days."""
    out = scenes
    if collection is not None:
        out = out.where(F.col("collection") == collection)
    if bbox is not None:
        west, south, east, north = bbox
        out = out.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1))
    if max_cloud is not None:
        out = out.where(F.col("cloud") < max_cloud)
    return out


def platform_filter(scenes: DataFrame, platform: str) -> DataFrame:
    """Terra or Aqua by id prefix: the platform property arrives empty."""
    if platform not in PLATFORMS:
        raise ValueError(f"platform must be one of {PLATFORMS}, got {platform!r}")
    return scenes if platform == "both" else scenes.where(F.col("scene_id").startswith(platform))


def property_of(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def edition_year() -> Column:
    """Year of a static product; its datetime is null, its start is in the properties."""
    return F.coalesce(F.year("ts"), F.substring(property_of("start_datetime"), 1, 4).try_cast("int"))


def band_scaling(band: str) -> tuple[Column, Column, Column]:
    """(scale, offset, nodata) of a band from scene metadata; absent entries default to 1, 0, 0."""
    info = F.try_element_at("bands", F.lit(band))
    return (
        F.coalesce(info["scale"], F.lit(1.0)),
        F.coalesce(info["offset"], F.lit(0.0)),
        F.coalesce(info["nodata"], F.lit(0.0)),
    )


def require_band_metadata(scenes: DataFrame, band: str) -> DataFrame:
    bad = scenes.where(F.try_element_at("bands", F.lit(band)).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['scene_id']}: no scaling metadata for band {band!r}")
    return scenes


def adaptive_cloud(scenes: DataFrame, threshold: float, *, min_scenes: int = 4, by: Sequence[str] = ("year", "month")) -> DataFrame:
    """Periods with too few clear scenes fall back to all their scenes.

    Counts per period join back; no period is gathered in one task.
    """
    by = list(by)
    clear = F.col("cloud") < threshold
    if threshold >= 100:
        return scenes.where(clear)
    counts = scenes.groupBy(*by).agg(F.sum(clear.cast("long")).alias("_clear"), F.count("*").alias("_all"))
    relax = (F.col("_clear") < min_scenes) & (F.col("_all") > F.col("_clear"))
    return scenes.join(counts, by).where(clear | relax).withColumn("relaxed", relax).drop("_clear", "_all")


def scene_gate(observations: DataFrame, *, by: Sequence[str] = ("year",), scene: str = "scene_id", value: str = "value", min_scenes: int = 6, max_gap: float = 0.15) -> DataFrame:
    """Per period: scenes used, gap share, and whether it passes or draws a warning."""
    return (
        observations.groupBy(*by)
        .agg(F.countDistinct(scene).alias("scenes"), F.avg(F.col(value).isNull().cast("double")).alias("gap_share"))
        .withColumn("accepted", F.col("scenes") >= min_scenes)
        .withColumn("warn_gap", F.col("gap_share") > max_gap)
    )


def require_series(periods: DataFrame, min_periods: int = 15) -> int:
    produced = periods.count()
    if produced < min_periods:
        raise ValueError(f"only {produced} periods could be produced, {min_periods} are needed for a baseline")
    return produced
