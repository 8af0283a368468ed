"""Resampling any source raster table onto the common grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import ratio
from aridscape.functions.geodesy import GEOGRAPHIC, with_transformed
from aridscape.sources.grid import GridSpec

METHODS = ("nearest", "bilinear", "cubic", "average", "mode", "max", "min")
CATEGORICAL_METHODS = ("nearest", "mode")


@dataclass(frozen=True)
class SourceRaster:
    """Geometry of a source layer: upper-left corner, cell size and reference system."""

    left: float
    top: float
    step_x: float
    step_y: float
    width: int
    height: int
    crs: str = GEOGRAPHIC


def _in_source(cells: DataFrame, grid: GridSpec, source: SourceRaster) -> DataFrame:
    """``cell_id`` with the fractional source (fr, fc) of its centre; integers are source cell edges."""
    moved = with_transformed(cells.select("cell_id", "x", "y"), "x", "y", grid.crs, source.crs, "_x", "_y")
    return moved.select(
        "cell_id",
        ((F.lit(source.top) - F.col("_y")) / source.step_y).alias("fr"),
        ((F.col("_x") - F.lit(source.left)) / source.step_x).alias("fc"),
    )


#: Share of a source cell below which an overlap is rounding of an edge.
SLIVER = 1e-6


def _overlaps(cells: DataFrame, grid: GridSpec, source: SourceRaster) -> DataFrame:
    """``cell_id, _r, _c, _w``: source cells under each target cell and the share of them it covers.

    The footprint is the box between two opposite corners, taken into the
    source's reference system; every target inside the source meets a source cell,
    whichever of the two is finer.
    """
    half = grid.resolution / 2
    first = with_transformed(
        cells.select("cell_id", (F.col("x") - half).alias("x"), (F.col("y") + half).alias("y"), (F.col("x") + half).alias("x2"), (F.col("y") - half).alias("y2")),
        "x", "y", grid.crs, source.crs, "_x0", "_y0",
    )
    both = with_transformed(first, "x2", "y2", grid.crs, source.crs, "_x1", "_y1")
    row = lambda y: (F.lit(source.top) - F.col(y)) / source.step_y
    col = lambda x: (F.col(x) - F.lit(source.left)) / source.step_x
    boxes = both.select(
        "cell_id",
        F.greatest(F.least(row("_y0"), row("_y1")), F.lit(0.0)).alias("r0"),
        F.least(F.greatest(row("_y0"), row("_y1")), F.lit(float(source.height))).alias("r1"),
        F.greatest(F.least(col("_x0"), col("_x1")), F.lit(0.0)).alias("c0"),
        F.least(F.greatest(col("_x0"), col("_x1")), F.lit(float(source.width))).alias("c1"),
    ).where((F.col("r1") - F.col("r0") > SLIVER) & (F.col("c1") - F.col("c0") > SLIVER))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) + SLIVER), F.ceil(F.col(hi) - SLIVER) - 1))
    part = lambda at, lo, hi: F.least(F.col(at) + 1.0, F.col(hi)) - F.greatest(F.col(at).cast("double"), F.col(lo))
    taps = boxes.withColumn("_r", span("r0", "r1")).withColumn("_c", span("c0", "c1"))
    return taps.select("cell_id", "_r", "_c", (part("_r", "r0", "r1") * part("_c", "c0", "c1")).alias("_w"))


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(1.0) - d, F.lit(0.0))


def _cubic(d: Column) -> Column:
    """Cubic convolution kernel with a = -0.5 at distance ``d``."""
    near = 1.5 * d * d * d - 2.5 * d * d + 1.0
    far = -0.5 * d * d * d + 2.5 * d * d - 4.0 * d + 2.0
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def regrid(source: DataFrame, cells: DataFrame, grid: GridSpec, raster: SourceRaster, method: str = "bilinear", *, categorical: bool = False, value: str = "value") -> DataFrame:
    """``cell_id, value`` for the target cells the source reaches.

    ``source`` holds ``row, col, value`` without rows for nodata. Interpolating
    methods look up 1, 4 or 16 source cells by key and renormalise over the
    defined ones; aggregating methods weigh all source cells under a target cell
    by the area they share with it (``mode`` takes the largest area, of equal ones
    the smallest code).
    """
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method!r}, expected one of {METHODS}")
    if categorical and method not in CATEGORICAL_METHODS:
        raise ValueError(f"{method} would invent class codes; use one of {CATEGORICAL_METHODS}")
    data = source.where(F.col(value).isNotNull())
    lookup = data.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias("_v"))
    if method in ("average", "mode", "max", "min"):
        under = _overlaps(cells, grid, raster).join(lookup, ["_r", "_c"])
        if method == "mode":
            areas = under.groupBy("cell_id", "_v").agg(F.sum("_w").alias("_w"))
            best = areas.groupBy("cell_id").agg(F.max(F.struct(F.round("_w", 6).alias("w"), (-F.col("_v")).alias("v"))).alias("top"))
            return best.select("cell_id", (-F.col("top.v")).alias(value))
        aggregate = {"average": ratio(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")), "max": F.max("_v"), "min": F.min("_v")}[method]
        return under.groupBy("cell_id").agg(aggregate.alias(value))
    placed = _in_source(cells, grid, raster).where(
        (F.col("fr") >= 0) & (F.col("fr") < raster.height) & (F.col("fc") >= 0) & (F.col("fc") < raster.width)
    )
    if method == "nearest":
        wanted = placed.select("cell_id", F.floor("fr").alias("_r"), F.floor("fc").alias("_c"))
        return wanted.join(lookup, ["_r", "_c"]).select("cell_id", F.col("_v").alias(value))
    before, after, kernel = (0, 1, _linear) if method == "bilinear" else (1, 2, _cubic)
    taps = lambda at: F.explode(F.sequence(F.floor(at) - before, F.floor(at) + after))
    near = (
        placed.select("cell_id", (F.col("fr") - 0.5).alias("fr"), (F.col("fc") - 0.5).alias("fc"))
        .withColumn("_r", taps("fr"))
        .withColumn("_c", taps("fc"))
        .withColumns({"_dr": F.abs(F.col("fr") - F.col("_r")), "_dc": F.abs(F.col("fc") - F.col("_c"))})
        .select("cell_id", "_r", "_c", (kernel(F.col("_dr")) * kernel(F.col("_dc"))).alias("_w"))
    )
    return (
        near.where(F.col("_w") != 0)
        .join(lookup, ["_r", "_c"])
        .groupBy("cell_id")
        .agg(ratio(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias(value))
        .where(F.col(value).isNotNull())
    )
