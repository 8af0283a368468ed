"""Common grid: definition, cell table, aligned layer scan and sink."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aridscape.functions.columns import nodata_to_null, null_to_nodata
from aridscape.functions.geodesy import with_utm

TILE = 512
NODATA = -9999.0
#: Cells of a range that is written together.
RANGE = 250_000


@dataclass(frozen=True)
class GridSpec:
    """Reference grid; north-up, square cells, row 0 at the top."""

    crs: str
    resolution: float
    width: int
    height: int
    left: float
    top: float

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise ValueError(f"grid size must be positive, got {self.width}x{self.height}")
        if self.resolution <= 0:
            raise ValueError(f"resolution must be positive, got {self.resolution}")

    @property
    def cell_count(self) -> int:
        return self.width * self.height

    @property
    def cell_km2(self) -> float:
        return self.resolution**2 / 1e6

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return (
            self.left,
            self.top - self.height * self.resolution,
            self.left + self.width * self.resolution,
            self.top,
        )

    def x_of(self, col: Column) -> Column:
        return F.lit(self.left) + (col + F.lit(0.5)) * F.lit(self.resolution)

    def y_of(self, row: Column) -> Column:
        return F.lit(self.top) - (row + F.lit(0.5)) * F.lit(self.resolution)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "GridSpec":
        return cls(**json.loads(text))


def cells(spark: SparkSession, grid: GridSpec, *, tile: int = TILE) -> DataFrame:
    """One row per cell: ``cell_id, row, col, x, y, tile``; a task makes a few million cells."""
    tiles_across = -(-grid.width // tile)
    parts = max(spark.sparkContext.defaultParallelism, grid.cell_count // 4_000_000 + 1)
    return (
        spark.range(0, grid.cell_count, numPartitions=parts)
        .withColumnRenamed("id", "cell_id")
        .withColumn("row", F.expr(f"cell_id div {grid.width}"))
        .withColumn("col", F.pmod("cell_id", F.lit(grid.width)))
        .withColumn("x", grid.x_of(F.col("col")))
        .withColumn("y", grid.y_of(F.col("row")))
        .withColumn("tile", F.expr(f"(row div {tile}) * {tiles_across} + (col div {tile})"))
    )


def projected_bounds(boxes: DataFrame, keys: Sequence[str], crs: str, *, points: int = 21) -> DataFrame:
    """Project lon/lat boxes (``west, south, east, north``) through densified edges.

    Each edge carries ``points`` interior points besides its corners, because
    the extreme of a projected edge need not sit at a corner.
    """
    steps = points + 1
    along = F.col("step") / F.lit(float(steps))
    lon = F.col("west") + (F.col("east") - F.col("west")) * along
    lat = F.col("south") + (F.col("north") - F.col("south")) * along
    edge = F.explode(
        F.array(
            F.struct(lon.alias("lon"), F.col("south").alias("lat")),
            F.struct(lon.alias("lon"), F.col("north").alias("lat")),
            F.struct(F.col("west").alias("lon"), lat.alias("lat")),
            F.struct(F.col("east").alias("lon"), lat.alias("lat")),
        )
    )
    outline = (
        boxes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        .select(*keys, edge.alias("p"))
        .select(*keys, "p.lon", "p.lat")
    )
    return (
        with_utm(outline, "lon", "lat", crs)
        .groupBy(*keys)
        .agg(
            F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top")
        )
    )


def snap_outward(bounds: DataFrame, resolution: float, *, buffer_m: float = 0.0, snap: bool = True) -> DataFrame:
    """Buffer, snap to multiples of the resolution and add ``width`` and ``height``."""
    r = float(resolution)
    low = lambda c: F.floor((F.col(c) - buffer_m) / r) * r if snap else F.col(c) - buffer_m
    high = lambda c: F.ceil((F.col(c) + buffer_m) / r) * r if snap else F.col(c) + buffer_m
    keys = [c for c in bounds.columns if c not in ("left", "bottom", "right", "top")]
    return bounds.select(
        *keys,
        low("left").cast("double").alias("left"),
        low("bottom").cast("double").alias("bottom"),
        high("right").cast("double").alias("right"),
        high("top").cast("double").alias("top"),
    ).withColumns(
        {
            "width": F.round((F.col("right") - F.col("left")) / r).cast("long"),
            "height": F.round((F.col("top") - F.col("bottom")) / r).cast("long"),
        }
    )


def build_grid(
    spark: SparkSession,
    bbox: Sequence[float],
    crs: str,
    resolution: float,
    *,
    buffer_m: float = 0.0,
    snap: bool = True,
) -> GridSpec:
    """Grid covering one lon/lat box."""
    if len(bbox) != 4:
        raise ValueError(f"bbox needs four numbers, got {bbox}")
    box = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in zip(("west", "south", "east", "north"), bbox)])
    row = snap_outward(projected_bounds(box.withColumn("k", F.lit(0)), ["k"], crs), resolution, buffer_m=buffer_m, snap=snap).first()
    return GridSpec(crs, float(resolution), row["width"], row["height"], row["left"], row["top"])


def save_grid(spark: SparkSession, grid: GridSpec, path: str) -> None:
    spark.range(1).select(F.lit(grid.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_grid(spark: SparkSession, path: str) -> GridSpec:
    try:
        return GridSpec.from_json(spark.read.text(path, wholetext=True).first()["value"])
    except Exception as error:
        raise FileNotFoundError(f"no grid definition at {path}: run the grid step first") from error


# --- layers ---------------------------------------------------------------------

#: Stored types of a layer's values, each with the marker of a missing one.
LAYER_TYPES = {"float": ("float", NODATA), "class": ("tinyint", 0)}
_MANIFEST = "_manifest"


def alignment_report(layer: DataFrame, grid: GridSpec, *, keys: Sequence[str] = ()) -> DataFrame:
    """Per layer: rows, cells outside the grid and duplicated cells.

    Duplicates are counted by a first aggregation on the cell, so no task sees
    a whole layer.
    """
    keys = list(keys)
    outside = ~F.col("cell_id").between(0, grid.cell_count - 1)
    return (
        layer.groupBy(*keys, "cell_id")
        .agg(F.count("*").alias("copies"))
        .groupBy(*keys)
        .agg(
            F.sum("copies").alias("rows"),
            F.sum(outside.cast("long")).alias("outside"),
            F.sum((F.col("copies") > 1).cast("long")).alias("duplicated"),
        )
    )


def write_layer(layer: DataFrame, grid: GridSpec, path: str, *, kind: str = "float", description: str | None = None) -> None:
    """Store ``cell_id, value`` with nodata markers; ``kind`` is ``float`` or ``class`` (8 bits, 0 is missing).

    The stored files are checked once: every cell of the grid, none twice, none
    beyond it. Only then does the layer get its manifest, without which it
    cannot be read; readers trust it and shuffle nothing.
    """
    stored, nodata = LAYER_TYPES[kind]
    value = null_to_nodata(F.col("value"), nodata).cast(stored)
    layer.select("cell_id", value.alias("value", metadata={"comment": description or ""})).write.mode("overwrite").parquet(path)
    spark = layer.sparkSession
    report = alignment_report(spark.read.parquet(path), grid).first()
    if report["rows"] != grid.cell_count or report["outside"] or report["duplicated"]:
        raise ValueError(f"{path}: expected {grid.cell_count} distinct cells, got {report.asDict()}")
    manifest = {"grid": json.loads(grid.to_json()), "kind": kind, "rows": report["rows"], "description": description}
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{_MANIFEST}")


def layer_manifest(spark: SparkSession, path: str) -> dict:
    """What ``write_layer`` found when it checked the layer."""
    try:
        return json.loads(spark.read.text(f"{path}/{_MANIFEST}", wholetext=True).first()["value"])
    except Exception as error:
        raise FileNotFoundError(f"no checked layer at {path}") from error


def aligned_scan(spark: SparkSession, path: str, grid: GridSpec) -> DataFrame:
    """Read a stored layer as ``cell_id, value``, missing cells null; reject one of another grid.

    A plain scan: cells were checked when the layer was written.
    """
    manifest = layer_manifest(spark, path)
    other = GridSpec.from_json(json.dumps(manifest["grid"]))
    same_shape = (other.width, other.height, other.crs) == (grid.width, grid.height, grid.crs)
    close = max(abs(other.left - grid.left), abs(other.top - grid.top), abs(other.resolution - grid.resolution))
    if not same_shape or close > 1e-6:
        raise ValueError(f"{path} is not aligned with the common grid: {other} != {grid}")
    stored, nodata = LAYER_TYPES[manifest["kind"]]
    layer = spark.read.schema(f"cell_id long, value {stored}").parquet(path)
    value = nodata_to_null(F.col("value"), nodata)
    return layer.select("cell_id", value.cast("double" if manifest["kind"] == "float" else "int").alias("value"))


def write_periods(layers: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Tall layer sink; only the partitions present in ``layers`` are replaced.

    Rows of one partition are spread over cell ranges first, so a partition is
    written by many tasks and its files carry tight cell statistics. A task sorts
    a bounded share however many rows a range holds: larger ones are split.
    """
    (
        layers.withColumn("_range", F.expr(f"cell_id div {RANGE}"))
        .hint("rebalance", *partition_by, "_range")
        .drop("_range")
        .sortWithinPartitions(*partition_by, "cell_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def discover_periods(layers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct periods present; answered from partition values where stored so."""
    return layers.select(*columns).distinct()


def missing_periods(wanted: DataFrame, existing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Periods still to be produced."""
    return wanted.join(existing.select(*columns).distinct(), list(columns), "left_anti")


def decimate(df: DataFrame, step: int) -> DataFrame:
    """Keep every ``step``-th row and column."""
    return df.where((F.pmod("row", F.lit(step)) == 0) & (F.pmod("col", F.lit(step)) == 0))


def block_id(size: int, blocks_across: int) -> Column:
    """Spatial block of a cell for blocked validation."""
    return F.expr(f"(row div {size}) * {blocks_across} + (col div {size})")
