"""Nested JSON summary for the map front end, and class overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.operators.regrid import SourceRaster, regrid
from aridscape.sources.grid import GridSpec


def class_records(summary: DataFrame, breaks: Sequence[float], labels: Mapping[int, str], colors: Sequence[str], *, bounds_stale: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Class rows with label, colour and upper bound; a stale bound is null rather than wrong."""
    code = F.col("class").cast("int")
    upper = F.element_at(F.array(*[F.lit(float(b)) for b in breaks]), code)
    stale = F.lit(False) if bounds_stale is None else bounds_stale
    return summary.where(F.col("class") > 0).select(
        *keys,
        "class",
        F.element_at(F.array(*[F.lit(labels[i]) for i in sorted(labels)]), code).alias("label"),
        F.when(~stale, F.round(upper, 4)).alias("upper_bound"),
        F.col("cells").alias("pixels"),
        F.round("share_pct", 1).alias("share_pct"),
        F.round("area_km2", 1).alias("area_km2"),
        F.element_at(F.array(*[F.lit(c) for c in colors]), code).alias("color"),
    )


def summary_json(classes: DataFrame, grid: Mapping[str, object], weights: Mapping[str, object], extra: Mapping[str, DataFrame] | None = None, *, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON text per key. Every list comes from an already reduced table."""
    keys = list(keys)
    by = keys or ["_all"]

    def packed(df: DataFrame, name: str) -> DataFrame:
        record = F.struct(*[F.col(c) for c in df.columns if c not in keys])
        keyed = df if keys else df.withColumn("_all", F.lit(0))
        return keyed.groupBy(*by).agg(F.sort_array(F.collect_list(record)).alias(name))

    out = packed(classes, "classes").withColumn("total_area_km2", F.round(F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["area_km2"]), 1))
    for name, df in (extra or {}).items():
        out = out.join(packed(df, name), by, "left")
    literal = lambda entries: F.struct(*[F.lit(v).alias(k) for k, v in entries.items()])
    body = F.struct(
        literal(grid).alias("grid"),
        literal(weights).alias("ahp"),
        F.struct("classes", "total_area_km2").alias("classification"),
        *[F.col(n) for n in (extra or {})],
    )
    return out.select(*keys, F.to_json(body).alias("json"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.select("json").write.mode("overwrite").text(path)


def class_overlay(classes: DataFrame, source: GridSpec, target_cells: DataFrame, target: GridSpec, palette: Sequence[str]) -> DataFrame:
    """Class raster on a geographic grid, nearest cell, with colour and alpha; masked is transparent."""
    raster = SourceRaster(source.left, source.top, source.resolution, source.resolution, source.width, source.height, source.crs)
    near = regrid(classes, target_cells, target, raster, "nearest", categorical=True)
    code = F.coalesce(F.col("value"), F.lit(0)).cast("int")
    color = F.when(code.between(1, len(palette)), F.element_at(F.array(*[F.lit(c) for c in palette]), F.greatest(code, F.lit(1))))
    return (
        target_cells.join(near, "cell_id", "left")
        .select("cell_id", "row", "col", code.alias("class"), color.alias("color"), F.when(color.isNotNull(), 255).otherwise(0).alias("alpha"))
    )
