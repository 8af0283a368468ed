"""Neighbourhood operators on a cell table with ``row`` and ``col``.

Cells are sent once to their tile, border cells also to the tiles next door.
Both window passes of a separable stencil then run inside a tile on the same
partitioning: one shuffle, and no window wider than a tile plus its halo.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.functions.columns import clip, ratio
from aridscape.operators.keyed import by_keys
from aridscape.operators.stats import hash_sample
from aridscape.sources.grid import TILE

_TILE_KEYS = ("_tr", "_tc")


def to_tiles(df: DataFrame, halo: int, *, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Copy border cells into neighbouring tiles and partition by tile."""
    if halo >= tile:
        raise ValueError(f"halo {halo} must be smaller than the tile {tile}")

    def homes(axis: str) -> Column:
        return F.array_distinct(
            F.array(*[F.expr(f"cast(floor(({axis} + {d}) / {tile}) as long)") for d in (-halo, 0, halo)])
        )

    return (
        df.withColumn("_tr", F.explode(homes("row")))
        .withColumn("_tc", F.explode(homes("col")))
        .repartition(*keys, *_TILE_KEYS)
    )


def own_cells(df: DataFrame, *, tile: int = TILE) -> DataFrame:
    """Drop halo copies after the windows ran."""
    return df.where(
        (F.expr(f"cast(floor(row / {tile}) as long)") == F.col("_tr"))
        & (F.expr(f"cast(floor(col / {tile}) as long)") == F.col("_tc"))
    ).drop(*_TILE_KEYS)


def _neighbours(value: Column, axis: str, window) -> tuple[Column, Column]:
    """Previous and next value along ``axis``; the cell itself at a border or gap."""
    before = F.when(F.lag(axis).over(window) == F.col(axis) - 1, F.lag(value).over(window))
    after = F.when(F.lead(axis).over(window) == F.col(axis) + 1, F.lead(value).over(window))
    return F.coalesce(before, value), F.coalesce(after, value)


def horn_gradients(
    df: DataFrame, z: str, cell_size: float, *, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Add ``dz_east`` and ``dz_north`` by the Horn 3x3 operator, edges replicated."""
    if cell_size <= 0:
        raise ValueError(f"cell size must be positive, got {cell_size}")
    along_row = Window.partitionBy(*keys, *_TILE_KEYS, "row").orderBy("col")
    along_col = Window.partitionBy(*keys, *_TILE_KEYS, "col").orderBy("row")
    west, east = _neighbours(F.col(z), "col", along_row)
    tiled = to_tiles(df, 1, tile=tile, keys=keys).withColumns(
        {"_across": east - west, "_smooth": west + 2 * F.col(z) + east}
    )
    north_d, south_d = _neighbours(F.col("_across"), "row", along_col)
    north_s, south_s = _neighbours(F.col("_smooth"), "row", along_col)
    scale = F.lit(8.0 * cell_size)
    graded = tiled.withColumns(
        {
            "dz_east": (north_d + 2 * F.col("_across") + south_d) / scale,
            "dz_north": (north_s - south_s) / scale,
        }
    )
    return own_cells(graded, tile=tile).drop("_across", "_smooth")


def slope_degrees(east: Column, north: Column) -> Column:
    return F.degrees(F.atan(F.hypot(east, north)))


def aspect_degrees(east: Column, north: Column) -> Column:
    """Downslope direction, clockwise from north."""
    # adding zero turns a negative zero into a positive one, which atan2 tells apart
    return F.pmod(F.degrees(F.atan2(F.lit(0.0) - east, F.lit(0.0) - north)), F.lit(360.0))


def southness(aspect: Column, slope: Column, *, flat_below: float = 1.0, flat_value: float = 0.5) -> Column:
    """0 facing north, 1 facing south, ``flat_value`` where the slope has no direction."""
    if not 0.0 <= flat_value <= 1.0:
        raise ValueError(f"flat_value must lie in [0, 1], got {flat_value}")
    score = (F.lit(1.0) - F.cos(F.radians(aspect))) / 2
    return clip(F.when(slope < flat_below, F.lit(flat_value)).otherwise(score), 0.0, 1.0)


def fill_with_mean(df: DataFrame, column: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Replace gaps by the layer mean (one small aggregation, then a literal), or by
    the mean of the cell's own ``keys``."""
    if keys:
        means = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
        return by_keys(df, means, keys).withColumn(column, F.coalesce(F.col(column), F.col("_mean"))).drop("_mean")
    mean = df.agg(F.avg(column).alias("m")).first()["m"]
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(mean)))


def focal_mean(
    df: DataFrame, value: str, output: str, size: int = 3, *, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Mean of the ``size`` x ``size`` window over the defined cells."""
    half = size // 2
    along_row = Window.partitionBy(*keys, *_TILE_KEYS, "row").orderBy("col").rangeBetween(-half, half)
    along_col = Window.partitionBy(*keys, *_TILE_KEYS, "col").orderBy("row").rangeBetween(-half, half)
    tiled = to_tiles(df, half, tile=tile, keys=keys).withColumns(
        {"_s": F.sum(value).over(along_row), "_n": F.count(value).over(along_row)}
    )
    summed = tiled.withColumns({"_s2": F.sum("_s").over(along_col), "_n2": F.sum("_n").over(along_col)})
    return own_cells(summed.withColumn(output, ratio(F.col("_s2"), F.col("_n2"))), tile=tile).drop("_s", "_n", "_s2", "_n2")


def pure_cells(
    df: DataFrame,
    class_column: str,
    width: int,
    height: int,
    *,
    size: int = 3,
    keys: Sequence[str] = (),
    tile: int = TILE,
) -> DataFrame:
    """Cells whose whole window carries their own class, clear of the border.

    Window extremes of the class code are compared, which needs no pass per class.
    """
    half = size // 2
    along_row = Window.partitionBy(*keys, *_TILE_KEYS, "row").orderBy("col").rangeBetween(-half, half)
    along_col = Window.partitionBy(*keys, *_TILE_KEYS, "col").orderBy("row").rangeBetween(-half, half)
    code = F.coalesce(F.col(class_column), F.lit(0))
    tiled = to_tiles(df, half, tile=tile, keys=keys).withColumns(
        {
            "_lo": F.min(code).over(along_row),
            "_hi": F.max(code).over(along_row),
            "_n": F.count("*").over(along_row),
        }
    )
    marked = tiled.withColumns(
        {
            "_lo2": F.min("_lo").over(along_col),
            "_hi2": F.max("_hi").over(along_col),
            "_n2": F.sum("_n").over(along_col),
        }
    )
    margin = half + 1
    inside = F.col("row").between(margin, height - 1 - margin) & F.col("col").between(margin, width - 1 - margin)
    same = (F.col("_lo2") == F.col("_hi2")) & (F.col("_n2") == size * size)
    kept = own_cells(marked, tile=tile).where(inside & same & F.col(class_column).isNotNull())
    return kept.drop("_lo", "_hi", "_n", "_lo2", "_hi2", "_n2")


def sample_pure_cells(pure: DataFrame, class_column: str, per_class: int, *, seed: int = 0, keys: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """So many pure cells of every class (and of every grid in ``keys``), by a seeded hash or by ``order``."""
    return hash_sample(pure, [*keys, class_column], per_class, ["cell_id"], seed=seed, order=order)
