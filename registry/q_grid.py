"""Grid and neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from aridscape.functions.geodesy import with_lonlat, with_utm
from aridscape.operators import composites, terrain
from aridscape.operators.distance import euclidean_distance, rasterize
from aridscape.operators.regrid import SourceRaster, regrid
from aridscape.sources.export import class_overlay
from aridscape.sources.grid import GridSpec, block_id, decimate

from registry.krueger_sql import project
from registry.views import CRS, LEFT, RES, TOP, WIDTH, query, r6, r9, sql


def _raster(v):
    return SourceRaster(LEFT, TOP, RES, RES, WIDTH, v.grid.height, CRS)


def _target(v, step: float, shift: float = 0.0):
    """Another grid over the same area, derived from the given cells' extent."""
    width, height = int(WIDTH * RES // step), int(v.grid.height * RES // step)
    grid = GridSpec(CRS, step, width, height, LEFT + shift, TOP - shift)
    from aridscape.sources.grid import cells

    return grid, cells(v.spark, grid)


def _aggregating(method: str, value: str):
    def build(v):
        grid, cells = _target(v, 60.0)
        source = v.cells.select("row", "col", F.col(value).alias("value"))
        return regrid(source, cells, grid, _raster(v), method).select("cell_id", r6(F.col("value")).alias("value"))

    return build


for _method, _expr in (("average", "avg(elev)"), ("max", "max(elev)"), ("min", "min(elev)")):
    query(
        f"g01_regrid_{_method}",
        sql("cells", f"""SELECT ("row" // 2) * 25 + col // 2 AS cell_id, round({_expr}, 6) AS value FROM cells, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) // 2 AS h FROM part)
        WHERE "row" // 2 < h GROUP BY 1"""),
    )(_aggregating(_method, "elev"))


@query("g01_regrid_mode", sql("cells", """SELECT cell_id, CAST(lc AS DOUBLE) AS value FROM (SELECT ("row" // 2) * 25 + col // 2 AS cell_id, lc,
  row_number() OVER (PARTITION BY "row" // 2, col // 2 ORDER BY count(*) DESC, lc) AS k
  FROM cells, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) // 2 AS h FROM part) WHERE "row" // 2 < h GROUP BY "row" // 2, col // 2, lc) WHERE k = 1"""))
def _(v):
    grid, cells = _target(v, 60.0)
    source = v.cells.select("row", "col", F.col("lc").alias("value"))
    return regrid(source, cells, grid, _raster(v), "mode", categorical=True).select("cell_id", F.col("value").cast("double").alias("value"))


_FINE = f"""dims2 AS (SELECT CAST(floor(CAST(ceil(count(*) / 50.0) AS BIGINT) * 30.0 / 45.0) AS BIGINT) AS th, CAST(ceil(count(*) / 50.0) AS BIGINT) AS sh FROM part),
fine AS (SELECT r.i * 33 + c.j AS cell_id, (7.0 + (r.i + 0.5) * 45.0) / 30.0 AS fr, (7.0 + (c.j + 0.5) * 45.0) / 30.0 AS fc, sh FROM (SELECT unnest(range(th)) AS i, sh FROM dims2) r, range(33) c(j))"""


_FOOTPRINT = f"""{_FINE}, boxes AS (SELECT cell_id, fr - 0.75 AS r0, fr + 0.75 AS r1, fc - 0.75 AS c0, fc + 0.75 AS c1 FROM fine),
under AS (SELECT b.cell_id, elev, (least(c."row" + 1, r1) - greatest(c."row", r0)) * (least(c.col + 1, c1) - greatest(c.col, c0)) AS w
  FROM boxes b JOIN cells c ON c."row" + 1 > r0 + 1e-6 AND c."row" < r1 - 1e-6 AND c.col + 1 > c0 + 1e-6 AND c.col < c1 - 1e-6)"""


@query("g01_regrid_area_average", sql("cells", "SELECT cell_id, round(sum(w * elev) / sum(w), 6) AS value FROM under GROUP BY 1", _FOOTPRINT))
def _(v):
    grid, cells = _target(v, 45.0, 7.0)
    source = v.cells.select("row", "col", F.col("elev").alias("value"))
    return regrid(source, cells, grid, _raster(v), "average").select("cell_id", r6(F.col("value")).alias("value"))


@query("g01_regrid_area_max", sql("cells", "SELECT cell_id, max(elev) AS value FROM under GROUP BY 1", _FOOTPRINT))
def _(v):
    grid, cells = _target(v, 45.0, 7.0)
    source = v.cells.select("row", "col", F.col("elev").alias("value"))
    return regrid(source, cells, grid, _raster(v), "max").select("cell_id", "value")


@query("g01_regrid_nearest", sql("cells", 'SELECT f.cell_id, c.elev AS value FROM fine f JOIN cells c ON c."row" = floor(fr) AND c.col = floor(fc)', _FINE))
def _(v):
    grid, cells = _target(v, 45.0, 7.0)
    source = v.cells.select("row", "col", F.col("elev").alias("value"))
    return regrid(source, cells, grid, _raster(v), "nearest").select("cell_id", "value")


def _interpolating_sql(taps: str, weight: str) -> str:
    return sql(
        "cells",
        """SELECT w.cell_id, round(sum(w * elev) / sum(w), 6) AS value FROM weighted w JOIN cells c ON c."row" = rr AND c.col = cc
        WHERE w <> 0 AND p_size % 25 <> 0 GROUP BY 1""",
        f"""{_FINE}, taps AS (SELECT cell_id, fr - 0.5 AS r, fc - 0.5 AS c, floor(fr - 0.5) + a.d AS rr, floor(fc - 0.5) + b.d AS cc
        FROM fine, {taps} WHERE fr >= 0 AND fr < sh AND fc >= 0 AND fc < 50),
        weighted AS (SELECT cell_id, rr, cc, {weight} AS w FROM taps)""",
    )


def _kernel(t: str) -> str:
    return f"""(CASE WHEN abs({t}) <= 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * abs({t}) ** 2 + 1 WHEN abs({t}) < 2
      THEN -0.5 * abs({t}) ** 3 + 2.5 * abs({t}) ** 2 - 4 * abs({t}) + 2 ELSE 0 END)"""


def _gappy(v):
    return v.cells.where("p_size % 25 <> 0").select("row", "col", F.col("elev").alias("value"))


@query("g01_regrid_bilinear", _interpolating_sql("range(2) a(d), range(2) b(d)", "greatest(1 - abs(r - rr), 0) * greatest(1 - abs(c - cc), 0)"))
def _(v):
    grid, cells = _target(v, 45.0, 7.0)
    return regrid(_gappy(v), cells, grid, _raster(v), "bilinear").select("cell_id", r6(F.col("value")).alias("value"))


@query("g01_regrid_cubic", _interpolating_sql("range(-1, 3) a(d), range(-1, 3) b(d)", f"{_kernel('r - rr')} * {_kernel('c - cc')}"))
def _(v):
    grid, cells = _target(v, 45.0, 7.0)
    return regrid(_gappy(v), cells, grid, _raster(v), "cubic").select("cell_id", r6(F.col("value")).alias("value"))


@query("g02_projection", "WITH p AS (SELECT c_custkey AS point, 24.5 + 5.0 * ((c_custkey * 7919) % 10007) / 10007.0 AS lon, 36.0 + 6.0 * ((c_custkey * 104729) % 10009) / 10009.0 AS lat FROM customer) "
       + "SELECT point, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (" + project("p", "point, lon, lat") + ")")
def _(v):
    key = F.col("c_custkey")
    points = v.table("customer").select(
        key.alias("point"), (24.5 + 5.0 * ((key * 7919) % 10007) / 10007.0).alias("lon"), (36.0 + 6.0 * ((key * 104729) % 10009) / 10009.0).alias("lat")
    )
    there = with_utm(points, "lon", "lat", CRS).select("point", "x", "y")
    back = with_lonlat(there, "x", "y", CRS)
    return back.select("point", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("g03_same_day_mosaic", sql("obs", """SELECT cell_id, day, round(arg_min(red, scene_id) FILTER (scl NOT IN (1, 3, 7)), 6) AS red, round(arg_min(nir, scene_id), 6) AS nir
  FROM obs GROUP BY 1, 2"""))
def _(v):
    masked = v.obs.withColumn("red", F.when(composites.scl_clear(F.col("scl"), (1, 3, 7)), F.col("red")))
    mosaic = composites.same_day_mosaic(masked, ["red", "nir"])
    return mosaic.select("cell_id", "day", r6("red").alias("red"), r6("nir").alias("nir"))


_HORN = f"""a AS (SELECT *, coalesce(lag(elev) OVER w, elev) AS we, coalesce(lead(elev) OVER w, elev) AS ea FROM cells WINDOW w AS (PARTITION BY "row" ORDER BY col)),
b AS (SELECT *, ea - we AS d, we + 2 * elev + ea AS s FROM a),
horn AS (SELECT cell_id, (coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d)) / {8 * RES} AS e,
 (coalesce(lag(s) OVER w, s) - coalesce(lead(s) OVER w, s)) / {8 * RES} AS n FROM b WINDOW w AS (PARTITION BY col ORDER BY "row"))
"""
_SLOPE = "degrees(atan(sqrt(e * e + n * n)))"
_ASPECT = "((degrees(atan2(0.0 - e, 0.0 - n)) % 360) + 360) % 360"


def _horn_sql(select: str) -> str:
    return sql("cells", select, _HORN)


def _graded(v):
    return terrain.horn_gradients(v.cells, "elev", RES, tile=16)


def _shape(v):
    east, north = F.col("dz_east"), F.col("dz_north")
    return terrain.slope_degrees(east, north), terrain.aspect_degrees(east, north)


@query("g04_horn_gradients", _horn_sql("SELECT cell_id, round(e, 9) + 0.0 AS dz_east, round(n, 9) + 0.0 AS dz_north FROM horn"))
def _(v):
    return _graded(v).select("cell_id", r9(F.col("dz_east")).alias("dz_east"), r9(F.col("dz_north")).alias("dz_north"))


@query("g05_slope", _horn_sql(f"SELECT cell_id, round({_SLOPE}, 6) AS slope FROM horn"))
def _(v):
    slope, _ = _shape(v)
    return _graded(v).select("cell_id", r6(slope).alias("slope"))


@query("g06_aspect", _horn_sql(f"SELECT cell_id, round({_ASPECT}, 6) AS aspect FROM horn"))
def _(v):
    _, aspect = _shape(v)
    return _graded(v).select("cell_id", r6(aspect).alias("aspect"))


@query("g07_southness", _horn_sql(f"SELECT cell_id, round(CASE WHEN {_SLOPE} < 1 THEN 0.5 ELSE (1 - cos(radians({_ASPECT}))) / 2 END, 6) + 0.0 AS southness FROM horn"))
def _(v):
    slope, aspect = _shape(v)
    return _graded(v).select("cell_id", r6(terrain.southness(aspect, slope)).alias("southness"))


@query("g08_gap_fill", sql("cells", "SELECT cell_id, round(coalesce(CASE WHEN p_size % 25 <> 0 THEN elev END, avg(CASE WHEN p_size % 25 <> 0 THEN elev END) OVER ()), 6) AS elev FROM cells"))
def _(v):
    gappy = v.cells.withColumn("elev", F.when(F.col("p_size") % 25 != 0, F.col("elev")))
    return terrain.fill_with_mean(gappy, "elev").select("cell_id", r6("elev").alias("elev"))


@query("g09_rasterize", sql("cells edges filled", f"""SELECT DISTINCT "row", col FROM (SELECT c."row", c.col FROM cells c, edges e,
  (SELECT 1) WHERE greatest(0, CASE WHEN x2 = x1 THEN 0 ELSE least(({LEFT} + c.col * {RES} - x1) / (x2 - x1), ({LEFT} + (c.col + 1) * {RES} - x1) / (x2 - x1)) END,
    CASE WHEN y2 = y1 THEN 0 ELSE least(({TOP} - c."row" * {RES} - y1) / (y2 - y1), ({TOP} - (c."row" + 1) * {RES} - y1) / (y2 - y1)) END)
  < least(1, CASE WHEN x2 = x1 THEN 1 ELSE greatest(({LEFT} + c.col * {RES} - x1) / (x2 - x1), ({LEFT} + (c.col + 1) * {RES} - x1) / (x2 - x1)) END,
    CASE WHEN y2 = y1 THEN 1 ELSE greatest(({TOP} - c."row" * {RES} - y1) / (y2 - y1), ({TOP} - (c."row" + 1) * {RES} - y1) / (y2 - y1)) END)
  UNION ALL SELECT "row", col FROM filled)"""))
def _(v):
    return rasterize(v.vectors, v.grid)


@query("g10_distance", sql("distance", "SELECT cell_id, distance_m FROM distance"))
def _(v):
    return v.distance.select("cell_id", "distance_m")


_LINES = """side AS (SELECT CAST(ceil((max(cell_id) + 1) / 4.0) AS BIGINT) AS n FROM cells),
lines AS (SELECT 'wide' AS grid, cell_id, cell_id // n AS "row", cell_id % n AS col, p_size = 50 AS wet FROM cells, side
  UNION ALL SELECT 'tall', cell_id, cell_id % n, cell_id // n, p_size = 50 FROM cells, side)"""


@query("g10_distance_lines", sql("cells", f"""SELECT a.grid, a.cell_id, round(min(sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)) * {RES}, 9) + 0.0 AS distance_m
  FROM lines a JOIN lines b ON a.grid = b.grid AND b.wet GROUP BY 1, 2""", _LINES))
def _(v):
    """Four lines as long as the table allows, worked off in stretches of 64 cells."""
    n = -(-(v.cells.agg(F.max("cell_id")).first()[0] + 1) // 4)
    long, short = F.expr(f"cell_id % {n}L"), F.expr(f"cell_id div {n}L")
    wet = (F.col("p_size") == 50).alias("wet")
    wet = (F.col("p_size") == 50).alias("wet")
    wide = v.cells.select("cell_id", short.alias("row"), long.alias("col"), wet)
    tall = v.cells.select("cell_id", long.alias("row"), short.alias("col"), wet)
    found = [
        euclidean_distance(lines, "wet", RES, shape=shape, span=64).select(F.lit(grid).alias("grid"), "cell_id", r9(F.col("distance_m")).alias("distance_m"))
        for grid, lines, shape in (("wide", wide, (4, n)), ("tall", tall, (n, 4)))
    ]
    return found[0].union(found[1])


@query("g11_decimate", sql("cells", 'SELECT cell_id, elev FROM cells WHERE "row" % 3 = 0 AND col % 3 = 0'))
def _(v):
    return decimate(v.cells, 3).select("cell_id", "elev")


@query("g12_focal_mean", sql("cells layers", """SELECT a.cell_id, round(sum(l.lst / 997.0) / nullif(count(l.lst), 0), 9) AS focal FROM cells a JOIN cells b
  ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 LEFT JOIN layers l ON l.cell_id = b.cell_id GROUP BY 1"""))
def _(v):
    placed = v.cells.select("cell_id", "row", "col").join(v.layers.select("cell_id", (F.col("lst") / 997.0).alias("lst")), "cell_id", "left")
    return terrain.focal_mean(placed, "lst", "focal", 3, tile=16).select("cell_id", r9(F.col("focal")).alias("focal"))


@query("g13_pure_cells", sql("zones dims", """SELECT a.cell_id, any_value(a.zone) AS zone FROM zones a JOIN zones b
  ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1, dims
  WHERE a."row" BETWEEN 2 AND h - 3 AND a.col BETWEEN 2 AND 47 GROUP BY 1 HAVING min(b.zone) = max(b.zone) AND count(*) = 9"""))
def _(v):
    return terrain.pure_cells(v.zones, "zone", WIDTH, v.grid.height, tile=16).select("cell_id", "zone")


_PURE = """pure AS (SELECT a.cell_id, any_value(a.zone) AS zone FROM zones a JOIN zones b
  ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1, dims
  WHERE a."row" BETWEEN 2 AND h - 3 AND a.col BETWEEN 2 AND 47 GROUP BY 1 HAVING min(b.zone) = max(b.zone) AND count(*) = 9)"""


@query("g13_pure_sample", sql("zones dims", """SELECT cell_id, zone FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY substr(md5(CAST(cell_id AS VARCHAR)), 1, 13)) AS k FROM pure) WHERE k <= 40""", _PURE))
def _(v):
    pure = terrain.pure_cells(v.zones, "zone", WIDTH, v.grid.height, tile=16)
    order = F.conv(F.substring(F.md5(F.col("cell_id").cast("string")), 1, 13), 16, 10)
    return terrain.sample_pure_cells(pure, "zone", 40, order=order).select("cell_id", "zone")


@query("g14_blocks", sql("cells", 'SELECT ("row" // 10) * 5 + col // 10 AS block, count(*) AS cells FROM cells GROUP BY 1'))
def _(v):
    return v.cells.groupBy(block_id(10, 5).alias("block")).agg(F.count("*").alias("cells"))


_STEP = 0.00027


_OVERLAY = f"""t AS (SELECT r.i * 60 + c.j AS cell_id, r.i AS "row", c.j AS col, 27.5985 + (c.j + 0.5) * {_STEP} AS lon, 38.7105 - (r.i + 0.5) * {_STEP} AS lat
  FROM (SELECT unnest(range(h)) AS i FROM dims) r, range(60) c(j)), p AS (""" + project("t", 'cell_id, "row", col') + ")"


@query("g15_class_overlay", sql("classes cells dims", f"""SELECT p.cell_id, p."row", p.col, coalesce(k.class, 0) AS class, CASE WHEN k.class > 0 THEN ['#f2e6c8','#e3c48a','#c9944f','#96602f','#573516'][k.class] END AS color,
  CASE WHEN k.class > 0 THEN 255 ELSE 0 END AS alpha FROM p LEFT JOIN cells c ON c."row" = floor(({TOP} - y) / {RES}) AND c.col = floor((x - {LEFT}) / {RES})
  LEFT JOIN classes k ON k.cell_id = c.cell_id""", _OVERLAY))
def _(v):
    from aridscape.sources.grid import cells

    target = GridSpec("EPSG:4326", _STEP, 60, v.grid.height, 27.5985, 38.7105)
    source = v.classes.join(v.cells.select("cell_id", "row", "col"), "cell_id").select("row", "col", F.col("class").alias("value"))
    palette = ["#f2e6c8", "#e3c48a", "#c9944f", "#96602f", "#573516"]
    return class_overlay(source, v.grid, cells(v.spark, target), target, palette)
