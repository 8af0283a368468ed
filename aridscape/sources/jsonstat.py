"""JSON-stat cubes: a flat index decoded by strides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUBE_SCHEMA = (
    "id array<string>, size array<int>, value map<string,double>, "
    "dimension map<string, struct<category: struct<index: map<string,int>>>>"
)


def parse_cubes(texts: DataFrame, *, column: str = "json", keys: Sequence[str] = ()) -> DataFrame:
    """JSON text -> ``keys, dims, sizes, codes, flat, value`` with one row per stored observation."""
    cube = texts.select(*keys, F.from_json(column, CUBE_SCHEMA).alias("c"))
    dims = F.coalesce(F.col("c.id"), F.map_keys("c.dimension"))
    codes = F.transform_values("c.dimension", lambda _, d: F.map_from_entries(
        F.transform(F.map_entries(d["category"]["index"]), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v")))
    ))
    sizes = F.coalesce(F.col("c.size"), F.transform(dims, lambda d: F.size(F.element_at(F.col("c.dimension"), d)["category"]["index"])))
    return cube.select(
        *keys, dims.alias("dims"), sizes.alias("sizes"), codes.alias("codes"), F.explode("c.value").alias("flat", "value")
    ).withColumn("flat", F.col("flat").cast("long"))


def stride(dim: str) -> Column:
    """Row-major stride of a dimension: the product of the sizes after it."""
    position = F.array_position("dims", F.lit(dim)).cast("int")
    return F.aggregate(F.slice("sizes", position + 1, F.size("sizes")), F.lit(1).cast("long"), lambda acc, s: acc * s)


def coordinate(dim: str) -> Column:
    """Category code of an observation along one dimension."""
    position = F.array_position("dims", F.lit(dim)).cast("int")
    index = F.pmod(F.floor(F.col("flat") / stride(dim)), F.element_at("sizes", position)).cast("int")
    return F.element_at(F.element_at("codes", F.lit(dim)), index)


def indicator_table(cells: DataFrame, indicator: str, crops: Mapping[str, str], *, keys: Sequence[str] = (), indicator_dim: str = "strucpro", crop_dim: str = "crops", time_dim: str = "time") -> DataFrame:
    """``keys, year, crop, value`` of one indicator for the listed crops, under their own names."""
    names = F.create_map(*[F.lit(v) for pair in crops.items() for v in pair])
    return (
        cells.select(*keys, coordinate(indicator_dim).alias("_i"), coordinate(crop_dim).alias("_c"), coordinate(time_dim).cast("int").alias("year"), "value")
        .where((F.col("_i") == indicator) & F.col("_c").isin(list(crops)))
        .select(*keys, "year", F.element_at(names, F.col("_c")).alias("crop"), "value")
    )


def year_by_crop(table: DataFrame, crops: Sequence[str], *, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Year rows, one column per crop; the crop list is given, so no extra scan finds it."""
    return table.groupBy(*keys, "year").pivot("crop", list(crops)).agg(F.first(value))
