"""Feature rasterisation and exact Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.session import cut_lineage
from aridscape.sources.grid import GridSpec


# --- rasterise -------------------------------------------------------------------


def segments(features: DataFrame, keys: Sequence[str], *, points: str = "points") -> DataFrame:
    """Explode ``array<struct<x,y>>`` paths into ``x1, y1, x2, y2``."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: F.struct(
            F.element_at(points, i.cast("int")).alias("a"), F.element_at(points, (i + 1).cast("int")).alias("b")
        ),
    )
    return (
        features.where(F.size(points) > 1)
        .select(*keys, F.explode(pairs).alias("s"))
        .select(*keys, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    )


def _in_cells(segment: DataFrame, grid: GridSpec, keys: Sequence[str]) -> DataFrame:
    """Coordinates in cell units: u grows with columns, v with rows."""
    u = lambda c: (F.col(c) - grid.left) / grid.resolution
    v = lambda c: (F.lit(grid.top) - F.col(c)) / grid.resolution
    return segment.select(*keys, u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2"))


def _span(low: Column, high: Column, size: int) -> Column:
    """Integer range clipped to the grid; empty where it misses it."""
    start, stop = F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(size - 1)).cast("long")
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))


def touched_cells(segment: DataFrame, grid: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell a segment passes through: per touched column, the clipped row interval."""
    keys = list(keys)
    cols = _in_cells(segment, grid, keys).withColumn(
        "col", F.explode(_span(F.floor(F.least("u1", "u2")), F.floor(F.greatest("u1", "u2")), grid.width))
    )
    du = F.col("u2") - F.col("u1")
    enter = F.greatest(F.least("u1", "u2"), F.col("col").cast("double"))
    leave = F.least(F.greatest("u1", "u2"), (F.col("col") + 1).cast("double"))
    at = lambda u: F.col("v1") + (F.col("v2") - F.col("v1")) * (u - F.col("u1")) / du
    va = F.when(du == 0, F.col("v1")).otherwise(at(enter))
    vb = F.when(du == 0, F.col("v2")).otherwise(at(leave))
    return (
        cols.withColumns({"_lo": F.floor(F.least(va, vb)), "_hi": F.floor(F.greatest(va, vb))})
        .select(*keys, F.explode(_span(F.col("_lo"), F.col("_hi"), grid.height)).alias("row"), "col")
        .distinct()
    )


def filled_cells(ring_segments: DataFrame, grid: GridSpec, keys: Sequence[str]) -> DataFrame:
    """Cells whose centre lies inside a polygon, by even-odd crossings per cell row.

    ``keys`` identify a polygon; all its rings (holes too) share them.
    """
    keys = list(keys)
    edge = _in_cells(ring_segments, grid, keys).where(F.col("v1") != F.col("v2"))
    top, bottom = F.least("v1", "v2"), F.greatest("v1", "v2")
    # rows whose centre r + 0.5 satisfies top <= r + 0.5 < bottom
    rows = edge.withColumn("row", F.explode(_span(F.ceil(top - 0.5), F.ceil(bottom - 0.5) - 1, grid.height)))
    crossing = F.col("u1") + (F.col("row") + 0.5 - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    order = Window.partitionBy(*keys, "row").orderBy("u")
    pairs = (
        rows.select(*keys, "row", crossing.alias("u"))
        .withColumns({"i": F.row_number().over(order), "u_next": F.lead("u").over(order)})
        .where((F.col("i") % 2 == 1) & F.col("u_next").isNotNull())
    )
    return pairs.select(
        *keys, "row", F.explode(_span(F.ceil(F.col("u") - 0.5), F.ceil(F.col("u_next") - 0.5) - 1, grid.width)).alias("col")
    ).distinct()


def rasterize(features: DataFrame, grid: GridSpec) -> DataFrame:
    """All cells touched by ``feature_id, geom_type, part, points`` features.

    ``geom_type`` is ``line`` or ``polygon``; rings of a polygon are separate
    parts. Returns distinct ``row, col``.
    """
    if features.isEmpty():
        raise ValueError("no feature geometry to rasterise")
    lines = touched_cells(segments(features, []), grid)
    rings = segments(features.where(F.col("geom_type") == "polygon"), ["feature_id"])
    inside = filled_cells(rings, grid, ["feature_id"]).select("row", "col")
    return lines.unionByName(inside).distinct()


# --- distance --------------------------------------------------------------------


#: Rows of a column, or columns of a row, that one group holds.
SPAN = 1 << 14
#: Borders between stretches that are priced at once, and parts in which those between two of them are.
FAN = 64


def _lowest_parabola(queries: np.ndarray, sites: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over sites of (q - s)^2 + h for sorted queries and sites, and a site that reaches it.

    The best site moves right as the query does, so each query only searches
    between the answers of its already solved neighbours; one numpy pass per
    halving of the stride.
    """
    m = queries.size
    if not m or not sites.size:
        return np.full(m, np.nan), np.full(m, np.nan)
    best = np.zeros(m, dtype="int64")
    value = np.empty(m)
    stride = 1 << max(m.bit_length() - 1, 0)
    while stride:
        pos = np.arange(stride - 1, m, 2 * stride)
        left, right = pos - stride, pos + stride
        lo = np.where(left >= 0, best[np.maximum(left, 0)], 0)
        hi = np.where(right < m, best[np.minimum(right, m - 1)], sites.size - 1)
        length = hi - lo + 1
        starts = np.concatenate(([0], np.cumsum(length)[:-1]))
        index = np.arange(length.sum()) - np.repeat(starts - lo, length)
        cost = (np.repeat(queries[pos], length) - sites[index]) ** 2 + heights[index]
        low = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(low, length))
        first = hits[np.searchsorted(hits, starts)]
        best[pos], value[pos] = index[first], low
        stride //= 2
    return value, sites[best]


def _nearest_in_column(cells: DataFrame, feature: str, keys: list[str], span: int | None) -> DataFrame:
    """``cells`` with ``gap``, the rows to the nearest feature of the column.

    With a ``span`` a column is scanned in stretches of so many rows; the nearest
    features outside a stretch come from the stretches' first and last features.
    """
    at = F.when(F.col(feature), F.col("row"))
    group = [*keys, "col"]
    if span:
        cells = cells.withColumn("_part", F.floor(F.col("row") / span))
        ends = cells.groupBy(*group, "_part").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
        column = Window.partitionBy(*group)
        before = Window.unboundedPreceding, -1
        ends = ends.select(
            *[F.col(k).alias(f"_e{i}") for i, k in enumerate(group)],
            F.col("_part").alias("_e_part"),
            F.last("_last", ignorenulls=True).over(column.orderBy("_part").rowsBetween(*before)).alias("_up"),
            F.last("_first", ignorenulls=True).over(column.orderBy(F.desc("_part")).rowsBetween(*before)).alias("_down"),
        )
        same = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(group)]
        cells = cells.join(ends, [*same, F.col("_part") == F.col("_e_part")])
        group = [*group, "_part"]
    stretch = Window.partitionBy(*group)
    # both directions look back along their own order: a frame that grows at
    # its far end is linear, one open towards the end would be quadratic
    so_far = Window.unboundedPreceding, 0
    above = F.last(at, ignorenulls=True).over(stretch.orderBy("row").rowsBetween(*so_far))
    below = F.last(at, ignorenulls=True).over(stretch.orderBy(F.desc("row")).rowsBetween(*so_far))
    if span:
        above, below = F.coalesce(above, F.col("_up")), F.coalesce(below, F.col("_down"))
    gap = F.least(F.col("row") - above, below - F.col("row"))
    return cells.select(*keys, "cell_id", "row", "col", gap.cast("double").alias("gap"))


def _sites_by_stretch(lines: DataFrame, keys: list[str], span: int, first: int, last: int) -> DataFrame:
    """The columns that may be nearest to a cell of each stretch of a row.

    The best column moves right with the cell, so those of a stretch lie between the
    best columns of its two borders: neighbouring stretches share at most one column.
    So do the borders: every stretch prices a few far apart, and those between two of
    them are priced only by the stretches between their best columns.
    """
    group = [*keys, "row"]
    sites = lines.where(F.col("gap").isNotNull())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*group).schema.fields)

    def priced(found: DataFrame, by: list[str], stride: int, within: int | None) -> DataFrame:
        """The borders on multiples of ``stride``, all or those inside the interval of ``within`` that ``_border`` begins."""

        def price(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("col")
            if within is None:
                borders = np.append(np.arange(first, last + 1, stride), last + 1)
            else:
                start = int(pdf["_border"].iloc[0])
                borders = np.arange(start, min(start + within, last + 1), stride)[1:]
            cost, site = _lowest_parabola((borders * span).astype("float64"), pdf["col"].to_numpy("float64"), pdf["gap"].to_numpy("float64") ** 2)
            head = {k: [pdf[k].iloc[0]] * len(borders) for k in group}
            return pd.DataFrame({**head, "_border": borders, "_cost": cost, "_site": site.astype("int64")})

        rows = found.groupBy(*by).applyInPandas(price, f"{types}, _border long, _cost double, _site long")
        return rows.groupBy(*group, "_border").agg(F.min_by("_site", "_cost").alias("_low"))

    def asked_of(best: DataFrame) -> DataFrame:
        """Sites between the best ones of neighbouring borders, with the border on the left."""
        high = F.lead("_low").over(Window.partitionBy(*group).orderBy("_border"))
        between = best.withColumn("_high", high).where(F.col("_high").isNotNull())
        held_by = F.sequence(F.floor(F.col("_low") / span), F.floor(F.col("_high") / span))
        asked = between.select(
            *[F.col(k).alias(f"_a{i}") for i, k in enumerate(group)], "_border", "_low", "_high", F.explode(held_by).alias("_held")
        )
        same = [F.col(k).eqNullSafe(F.col(f"_a{i}")) for i, k in enumerate(group)]
        return sites.join(asked, [*same, F.col("_part") == F.col("_held"), F.col("col").between(F.col("_low"), F.col("_high"))])

    stride = 1
    while (last + 1 - first) / stride > FAN:
        stride *= FAN
    best = priced(sites, [*group, "_part"], stride, None)
    while stride > 1:
        best = cut_lineage(best)
        within, stride = stride, stride // FAN
        best = best.unionByName(priced(asked_of(best), [*group, "_border", "_part"], stride, within))
    found = asked_of(best)
    return found.select(*group, F.col("_border").alias("_part"), "col", "gap")


def euclidean_distance(
    cells: DataFrame,
    feature: str,
    cell_size: float,
    *,
    keys: Sequence[str] = (),
    shape: tuple[int, int] | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Exact distance in metres from each cell to the nearest feature cell.

    Pass one finds the nearest feature up or down the column; pass two takes the
    lower envelope along the row. Columns of more than ``span`` rows and rows of
    more than ``span`` columns are worked off in stretches, so that no line has
    to fit a task. ``shape`` (height, width) saves the look at the grid's extent.
    The result is null where a grid holds no feature.
    """
    keys = list(keys)
    if shape is None:
        extent = cells.agg(*[F.coalesce(f(c), F.lit(0)) for c in ("row", "col") for f in (F.min, F.max)]).first()
    else:
        extent = (0, shape[0] - 1, 0, shape[1] - 1)
    top, bottom, first, last = (int(v // span) for v in extent)
    lines = _nearest_in_column(cells, feature, keys, span if bottom > top else None)
    # short rows share a group, so that a group holds some span cells however narrow the grid is
    rows = max(1, span // int(extent[3] - extent[2] + 1))
    group = [*keys, "_band"]
    if last > first:
        lines = cut_lineage(lines.withColumn("_part", F.floor(F.col("col") / span)))
        sites = _sites_by_stretch(lines, keys, span, first, last)
        lines = lines.withColumn("gap", F.lit(None).cast("double")).unionByName(sites, allowMissingColumns=True)
        group = [*group, "_part"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys, "cell_id", "row", "col").schema.fields)

    def envelope(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        row = pdf["row"].to_numpy()
        known = pdf["gap"].notna().to_numpy()
        asked = pdf["cell_id"].notna().to_numpy()
        at, height = pdf["col"].to_numpy("float64"), pdf["gap"].to_numpy("float64") ** 2
        squared = np.full(len(pdf), np.nan)
        ends = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(row)]):
            k, q = a + np.flatnonzero(known[a:b]), a + np.flatnonzero(asked[a:b])
            squared[q], _ = _lowest_parabola(at[q], at[k], height[k])
        return pdf.loc[asked, [*keys, "cell_id", "row", "col"]].assign(distance_m=np.sqrt(squared[asked]) * cell_size)

    lines = lines.withColumn("_band", F.floor(F.col("row") / rows))
    out = lines.groupBy(*group).applyInPandas(envelope, f"{types}, distance_m double")
    return out.withColumn("distance_m", F.when(~F.isnan("distance_m"), F.col("distance_m")))


def require_features(mask: DataFrame) -> DataFrame:
    """Guard for callers that must fail on an empty feature mask."""
    if mask.isEmpty():
        raise ValueError("the feature mask is empty: distance is undefined")
    return mask
