"""Tagged vector features: selection, clipping and network summary.

A feature row is ``feature_id, geom_type (line|polygon), part, points
array<struct<x,y>>, tags map<string,string>``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import ratio
from aridscape.operators.distance import segments


def tag_value(name: str):
    return F.try_element_at("tags", F.lit(name))


def tagged_features(features: DataFrame, groups: Sequence[Mapping[str, Sequence[str]]], *, exclude: Mapping[str, Sequence[str]] | None = None, failed: Sequence[str] = ()) -> DataFrame:
    """Features matching any tag of any group, minus excluded values.

    A group that could not be read makes the network incomplete, which is an
    error; a group without matches is not. A feature found by several groups
    appears once.
    """
    if failed:
        raise RuntimeError(f"feature groups could not be read: {list(failed)}; a partial network gives wrong distances")
    match = reduce(
        lambda a, b: a | b, [F.coalesce(tag_value(k).isin(list(v)), F.lit(False)) for g in groups for k, v in g.items()]
    )
    out = features.where(match)
    for key, values in (exclude or {}).items():
        out = out.where(~F.coalesce(tag_value(key).isin(list(values)), F.lit(False)))
    return out


def clipped_lines(features: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Line segments cut to the box by their entry and exit parameters (Liang-Barsky)."""
    left, bottom, right, top = (F.lit(float(b)) for b in bounds)
    seg = segments(features.where(F.col("geom_type") == "line"), ["feature_id"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for delta, start, low, high in ((dx, F.col("x1"), left, right), (dy, F.col("y1"), bottom, top)):
        ta, tb = ratio(low - start, delta), ratio(high - start, delta)
        enter = F.greatest(enter, F.least(ta, tb))
        leave = F.least(leave, F.greatest(ta, tb))
        outside = outside | ((delta == 0) & ((start < low) | (start > high)))
    cut = seg.withColumns({"_t0": enter, "_t1": leave}).where(~outside & (enter < leave))
    at = lambda t, p, d: F.col(p) + F.col(t) * d
    return cut.select(
        "feature_id", at("_t0", "x1", dx).alias("x1"), at("_t0", "y1", dy).alias("y1"),
        at("_t1", "x1", dx).alias("x2"), at("_t1", "y1", dy).alias("y2"),
    )


def clipped_ring_area(features: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Area of each polygon inside the box, without building the clipped ring.

    The area between two boundary curves, cut to the box, is the integral of
    their clamped heights; so every edge contributes on its own the integral
    of its height clamped to the box over its x-range cut to the box. Holes
    run the other way round and subtract; rounding slivers are dropped.
    """
    left, bottom, right, top = bounds
    height = F.lit(float(top - bottom))
    edge = segments(features.where(F.col("geom_type") == "polygon"), ["feature_id"])
    cut = lambda c: F.least(F.greatest(F.col(c), F.lit(float(left))), F.lit(float(right)))
    sloped = edge.withColumns(
        {"_xa": cut("x1"), "_xb": cut("x2"), "_m": ratio(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))}
    ).where(F.col("_m").isNotNull() & (F.col("_xa") != F.col("_xb")))
    at = lambda x: F.col("y1") + F.col("_m") * (F.col(x) - F.col("x1")) - F.lit(float(bottom))
    primitive = lambda y: F.when(y <= 0, F.lit(0.0)).when(y <= height, y * y / 2).otherwise(height * height / 2 + height * (y - height))
    clamped = lambda y: F.least(F.greatest(y, F.lit(0.0)), height)
    width = F.col("_xb") - F.col("_xa")
    flat = F.abs(F.col("_yb") - F.col("_ya")) < 1e-9
    part = F.when(flat, clamped(F.col("_ya")) * width).otherwise((primitive(F.col("_yb")) - primitive(F.col("_ya"))) / F.col("_m"))
    return (
        sloped.withColumns({"_ya": at("_xa"), "_yb": at("_xb")})
        .groupBy("feature_id")
        .agg(F.abs(F.sum(part)).alias("area"))
        .where(F.col("area") > 1e-6)
    )


def network_summary(features: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Features inside the box, km of lines and km2 of polygons after clipping."""
    lines = clipped_lines(features, bounds).select(
        "feature_id", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"), F.lit(0.0).alias("area")
    )
    areas = clipped_ring_area(features, bounds).select("feature_id", F.lit(0.0).alias("length"), "area")
    per_feature = lines.unionByName(areas).groupBy("feature_id").agg(F.sum("length").alias("length"), F.sum("area").alias("area"))
    return per_feature.agg(
        F.count("*").alias("features"), (F.coalesce(F.sum("length"), F.lit(0.0)) / 1000).alias("line_km"),
        (F.coalesce(F.sum("area"), F.lit(0.0)) / 1e6).alias("polygon_km2"),
    )


def aoi_cells(cells: DataFrame, *, bbox: Sequence[float], inside: DataFrame | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cells of the box, further limited to those of the union of admin polygons."""
    west, south, east, north = bbox
    boxed = cells.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))
    out = boxed if inside is None else boxed.join(inside.select("row", "col").distinct(), ["row", "col"], "left_semi")
    if out.isEmpty():
        raise ValueError("the area polygons and the box do not intersect")
    return out
