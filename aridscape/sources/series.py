"""Climate series: gridded values to regional means, CSV scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("ppt", "pdsi", "pet", "soil", "tmax")


#: Fine cells along a bin, and tasks that share the points of one border cell.
FINE, SALTS = 8, 16


def region_mean(gridded: DataFrame, variable: str, regions: DataFrame, *, time: str = "month", bin_deg: float = 0.5) -> DataFrame:
    """Mean over each region's box of ``lat, lon, time, value``.

    Points are added up per fine cell before they meet a box, so any number of
    points in one place becomes one row per time. Cells inside a box, away from its
    edges, count as a whole. Points of the cells that an edge runs through
    are compared with the exact bounds; they meet the boxes on cell and a
    salt, so a crowded cell is spread over tasks.
    """
    fine = bin_deg / FINE
    cell = lambda c: F.floor(F.col(c) / fine)
    boxes = regions.select("region_id", "west", "east", "south", "north", cell("west").alias("_w"), cell("east").alias("_e"), cell("south").alias("_s"), cell("north").alias("_n"))
    points = gridded.select(time, "lon", "lat", "value", cell("lon").alias("_x"), cell("lat").alias("_y"))
    sums = [F.sum("value").alias("_sum"), F.count("value").alias("_count")]
    coarse = lambda c: F.floor(F.col(c) / FINE)

    # a cell beyond the edge's own cell on both axes lies wholly inside
    whole = points.groupBy(time, "_x", "_y").agg(*sums).withColumns({"_bx": coarse("_x"), "_by": coarse("_y")})
    wide = boxes.where("_e - _w > 1 AND _n - _s > 1")
    binned = wide.withColumn("_bx", F.explode(F.sequence(coarse("_w"), coarse("_e")))).withColumn("_by", F.explode(F.sequence(coarse("_s"), coarse("_n"))))
    inside = (F.col("_x") > F.col("_w")) & (F.col("_x") < F.col("_e")) & (F.col("_y") > F.col("_s")) & (F.col("_y") < F.col("_n"))
    inner = whole.join(binned, ["_bx", "_by"]).where(inside).groupBy("region_id", time).agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))

    across, along = F.sequence("_w", "_e"), F.sequence("_s", "_n")
    place = lambda x, y: F.struct(x.alias("_x"), y.alias("_y"))
    edge = F.array_distinct(F.concat(
        F.transform(across, lambda x: place(x, F.col("_s"))), F.transform(across, lambda x: place(x, F.col("_n"))),
        F.transform(along, lambda y: place(F.col("_w"), y)), F.transform(along, lambda y: place(F.col("_e"), y)),
    ))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    edges = boxes.withColumn("_cell", F.explode(edge)).select("region_id", "west", "east", "south", "north", "_cell._x", "_cell._y", F.explode(salts).alias("_salt"))
    salt = F.pmod(F.xxhash64(time, "lon", "lat", "value"), F.lit(SALTS)).cast("int")
    exact = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    outer = points.withColumn("_salt", salt).join(edges, ["_x", "_y", "_salt"]).where(exact).groupBy("region_id", time).agg(*sums)
    both = inner.unionByName(outer).groupBy("region_id", time).agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))
    return both.select("region_id", time, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias(variable))


def combine_variables(parts: dict[str, DataFrame], *, keys: Sequence[str] = ("region_id", "month")) -> DataFrame:
    """One row per key with a column per variable; a variable may end early or lack rows."""
    if not parts:
        raise ValueError("no variable could be read")
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
    return tall.groupBy(*keys).agg(*[F.max(v).alias(v) for v in parts])


def concat_years(parts: Sequence[DataFrame]) -> DataFrame:
    """Yearly pieces of one variable; pieces that are missing are simply not in the list."""
    if not parts:
        raise ValueError("no year could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_monthly_csv(spark: SparkSession, path: str, columns: Sequence[str] = VARIABLES) -> DataFrame:
    schema = "time date, " + ", ".join(f"{c} double" for c in columns)
    try:
        return spark.read.csv(path, header=True, schema=schema, nanValue="", enforceSchema=False).withColumnRenamed("time", "month")
    except Exception as error:
        raise FileNotFoundError(f"no climate series at {path}: run the series step first") from error


def monthly_from_csv(lines: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Parse ``line`` = ``time,v1,v2,...`` rows with a declared schema."""
    schema = "month date, " + ", ".join(f"`{c}` double" for c in columns)
    return lines.select(*keys, F.from_csv("line", F.lit(schema)).alias("r")).select(*keys, "r.*")
