"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from aridscape.functions.columns import nodata_to_null, null_to_nodata
from aridscape.operators.classify import class_summary
from aridscape.operators.composites import ndvi, scl_clear
from aridscape.operators.distance import filled_cells, segments
from aridscape.operators.normalize import directed, percentile_bounds, rescale
from aridscape.session import shared_path
from aridscape.sources import export, features, jsonstat, scenes, series, survey
from aridscape.sources.grid import (
    NODATA, aligned_scan, alignment_report, discover_periods, missing_periods, projected_bounds, snap_outward, write_layer, write_periods,
)

from registry.krueger_sql import project
from registry.views import CRITERIA, CRS, LABELS, LEFT, RES, TOP, WEIGHTS, WIDTH, query, r6, sql

# --- S01, S02: one grid per nation -----------------------------------------------

_BOXES = """boxes AS (SELECT c_nationkey AS nation, 24.6 + 0.2 * c_nationkey AS west, 36.0 + 0.1 * c_nationkey AS south,
  24.6 + 0.2 * c_nationkey + 0.05 + count(*) * 0.0001 AS east, 36.0 + 0.1 * c_nationkey + 0.08 AS north FROM customer GROUP BY 1),
outline AS (SELECT nation, west + (east - west) * t / 22.0 AS lon, south AS lat FROM boxes, range(23) r(t)
  UNION ALL SELECT nation, west + (east - west) * t / 22.0, north FROM boxes, range(23) r(t)
  UNION ALL SELECT nation, west, south + (north - south) * t / 22.0 FROM boxes, range(23) r(t)
  UNION ALL SELECT nation, east, south + (north - south) * t / 22.0 FROM boxes, range(23) r(t)),
placed AS (""" + project("outline", "nation") + """),
grids AS (SELECT nation, floor(min(x) / 30) * 30.0 AS "left", floor(min(y) / 30) * 30.0 AS bottom,
  ceil(max(x) / 30) * 30.0 AS "right", ceil(max(y) / 30) * 30.0 AS top FROM placed GROUP BY 1)
"""


def _nation_grids(v):
    key = F.col("c_nationkey")
    boxes = (
        v.table("customer").groupBy(key.alias("nation")).agg(F.count("*").alias("n"))
        .withColumn("west", 24.6 + F.lit(0.2) * F.col("nation"))
        .withColumn("south", 36.0 + F.lit(0.1) * F.col("nation"))
        .withColumn("east", F.col("west") + 0.05 + F.col("n") * 0.0001)
        .withColumn("north", F.col("south") + 0.08)
    )
    return snap_outward(projected_bounds(boxes, ["nation"], CRS), RES)


@query("s01_grid_cells", "WITH " + _BOXES + """SELECT nation, "left", bottom, "right", top,
  CAST(round(("right" - "left") / 30) AS BIGINT) AS width, CAST(round((top - bottom) / 30) AS BIGINT) AS height FROM grids""")
def _(v):
    return _nation_grids(v)


@query("s02_grid_definition", "WITH " + _BOXES + """SELECT nation, 'EPSG:32635' AS crs, CAST(30 AS DOUBLE) AS resolution,
  CAST(round(("right" - "left") / 30) AS BIGINT) AS width, CAST(round((top - bottom) / 30) AS BIGINT) AS height, "left", top FROM grids""")
def _(v):
    text = F.to_json(F.struct(F.lit(CRS).alias("crs"), F.lit(RES).alias("resolution"), "width", "height", "left", "top"))
    schema = "crs string, resolution double, width bigint, height bigint, left double, top double"
    return _nation_grids(v).select("nation", F.from_json(text, schema).alias("g")).select("nation", "g.*")


# --- S03-S05: layers --------------------------------------------------------------


@query("s03_aligned_scan", """SELECT l_returnflag AS layer, CAST(sum(c) AS BIGINT) AS "rows", CAST(sum(CASE WHEN l_partkey >= n THEN 1 ELSE 0 END) AS BIGINT) AS outside,
  CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated FROM (SELECT l_returnflag, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2),
  (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) * 50 AS n FROM part) GROUP BY 1""")
def _(v):
    lines = v.table("lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_partkey").alias("cell_id"))
    return alignment_report(lines, v.grid, keys=["layer"])


def _stored(v, name, kind="float"):
    """A layer of the grid's cells, written, checked and read back."""
    path = shared_path(v.spark, name)
    cells = v.spark.range(v.grid.cell_count).withColumnRenamed("id", "cell_id")
    value = v.layers.select("cell_id", F.col(name).alias("value")) if kind == "float" else v.cells.select("cell_id", F.col("lc").cast("tinyint").alias("value"))
    write_layer(cells.join(value, "cell_id", "left"), v.grid, path, kind=kind, description=name)
    return aligned_scan(v.spark, path, v.grid)


_GRID = f"all_cells AS (SELECT unnest(range(h * {WIDTH})) AS cell_id FROM dims)"


@query("s03_stored_layer", sql("layers dims", "SELECT cell_id, round(CAST(CAST(lst AS FLOAT) AS DOUBLE), 3) AS value FROM all_cells LEFT JOIN layers USING (cell_id)", _GRID))
def _(v):
    return _stored(v, "lst").select("cell_id", F.round("value", 3).alias("value"))


@query("s05_class_layer", sql("cells dims", "SELECT cell_id, CAST(lc AS INT) AS value FROM all_cells LEFT JOIN cells USING (cell_id)", _GRID))
def _(v):
    return _stored(v, "landcover", kind="class")


@query("s05_period_store", """SELECT CAST(year(l_shipdate) AS INT) AS "year", count(*) AS "rows", round(sum(CASE WHEN year(l_shipdate) = 1998 THEN 2 ELSE 1 END * l_quantity), 6) AS total FROM lineitem GROUP BY 1""")
def _(v):
    # one year is written a second time with other values: only its partition is replaced
    path = shared_path(v.spark, "periods")
    lines = v.table("lineitem").select(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("value"))
    write_periods(lines, path, ["year"])
    write_periods(lines.where("year = 1998").withColumn("value", F.col("value") * 2), path, ["year"])
    return v.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("rows"), r6(F.sum("value")).alias("total"))


@query("s18_missing_in_store", """SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS "year" FROM orders WHERE year(o_orderdate) NOT IN (1996, 1998)""")
def _(v):
    path = shared_path(v.spark, "periods")
    lines = v.table("lineitem").select(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("value"))
    write_periods(lines.where("year IN (1996, 1998)"), path, ["year"])
    wanted = v.table("orders").select(F.year("o_orderdate").alias("year")).distinct()
    return missing_periods(wanted, discover_periods(v.spark.read.parquet(path), ["year"]), ["year"])


@query("s04_nodata_decode", sql("layers", "SELECT cell_id, round(CAST(lst AS FLOAT), 3) AS lst, lst IS NULL AS masked FROM layers"))
def _(v):
    stored = v.layers.select("cell_id", null_to_nodata(F.col("lst"), NODATA).cast("float").alias("lst"))
    decoded = stored.withColumn("lst", nodata_to_null(F.col("lst"), NODATA))
    return decoded.select("cell_id", F.round("lst", 3).alias("lst"), F.col("lst").isNull().alias("masked"))


@query("s05_layer_sink", sql("layers", """SELECT layer, count(*) AS "rows", CAST(sum(CASE WHEN value = CAST(-9999 AS FLOAT) THEN 1 ELSE 0 END) AS BIGINT) AS nodata_rows,
  round(sum(CAST(value AS DOUBLE)), 2) AS total FROM (SELECT 'lst' AS layer, CAST(coalesce(lst, -9999) AS FLOAT) AS value FROM layers
  UNION ALL SELECT 'soil', CAST(coalesce(soil, -9999) AS FLOAT) FROM layers) GROUP BY 1"""))
def _(v):
    tall = v.layers.unpivot("cell_id", ["lst", "soil"], "layer", "value")
    stored = tall.withColumn("value", null_to_nodata(F.col("value"), NODATA).cast("float"))
    return stored.groupBy("layer").agg(
        F.count("*").alias("rows"),
        F.sum((F.col("value") == F.lit(NODATA).cast("float")).cast("long")).alias("nodata_rows"),
        F.round(F.sum(F.col("value").cast("double")), 2).alias("total"),
    )


# --- S06, S07: climate series --------------------------------------------------------


@query("s06_monthly_csv", sql("climate", 'SELECT region_id, "month", ppt, soil, pdsi FROM climate'))
def _(v):
    lines = v.climate.select("region_id", F.concat_ws(",", F.col("month").cast("string"), *[F.col(c).cast("string") for c in ("ppt", "soil", "pdsi")]).alias("line"))
    return series.monthly_from_csv(lines, ["ppt", "soil", "pdsi"], keys=["region_id"])


@query("s07_region_mean", """WITH g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS "month", 27.01 + (l_partkey % 50) * 0.02 AS lon,
  38.99 - (l_partkey // 50) * 0.02 AS lat, l_quantity * 1.000123457 AS q, l_discount * 1.000123457 AS d FROM lineitem),
  b AS (SELECT r_regionkey AS region_id, 27.0 + 0.2 * r_regionkey AS west, 27.2 + 0.2 * r_regionkey AS east,
          38.98 - (SELECT max(l_partkey) // 50 FROM lineitem) * 0.02 AS south, 39.0 AS north FROM region)
  SELECT region_id, "month", round(avg(q), 6) AS ppt, round(avg(CASE WHEN year("month") <= 1999 THEN d END), 6) AS soil
  FROM g JOIN b ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1, 2""")
def _(v):
    points = v.table("lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"),
        (27.01 + (F.col("l_partkey") % 50) * 0.02).alias("lon"),
        (38.99 - F.expr("l_partkey div 50") * 0.02).alias("lat"),
        # a long fraction, so that no mean ends in an exact half
        (F.col("l_quantity") * 1.000123457).alias("l_quantity"), (F.col("l_discount") * 1.000123457).alias("l_discount"),
    )
    # boxes as high as the grid, which grows with the parts
    rows = v.table("lineitem").agg(F.expr("max(l_partkey) div 50")).first()[0]
    boxes = v.table("region").select(
        F.col("r_regionkey").alias("region_id"), (27.0 + F.lit(0.2) * F.col("r_regionkey")).alias("west"),
        (27.2 + F.lit(0.2) * F.col("r_regionkey")).alias("east"), F.lit(38.98 - rows * 0.02).alias("south"), F.lit(39.0).alias("north"),
    )
    rain = series.region_mean(points.withColumnRenamed("l_quantity", "value"), "ppt", boxes)
    # the second variable ends early: its missing tail stays null
    soil = series.region_mean(points.where(F.year("month") <= 1999).withColumnRenamed("l_discount", "value"), "soil", boxes)
    return series.combine_variables({"ppt": rain, "soil": soil}).select("region_id", "month", r6("ppt").alias("ppt"), r6("soil").alias("soil"))


# --- S08-S11: scenes ---------------------------------------------------------------


@query("s08_scene_filter", sql("scenes", "SELECT scene_id, CAST(ts AS DATE) AS day, cloud FROM scenes WHERE ts >= DATE '1996-07-01' AND ts < DATE '1997-10-01' AND cloud < 20"))
def _(v):
    found = scenes.select_scenes(v.scenes, start="1996-07-01", end="1997-09-30", max_cloud=20)
    return found.select("scene_id", F.col("ts").cast("date").alias("day"), "cloud")


@query("s09_platform_filter", sql("scenes", "SELECT scene_id, CAST(substr(start_datetime, 1, 4) AS INT) AS edition FROM scenes WHERE starts_with(scene_id, 'MYD11A2')"))
def _(v):
    undated = v.scenes.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return scenes.platform_filter(undated, "MYD11A2").select("scene_id", scenes.edition_year().alias("edition"))


@query("s10_adaptive_cloud", sql("scenes", """SELECT scene_id, "year", "month", clear < 4 AND total > clear AS relaxed FROM (SELECT scene_id, cloud, CAST(year(ts) AS INT) AS "year", CAST(month(ts) AS INT) AS "month",
  count(*) FILTER (cloud < 2) OVER w AS clear, count(*) OVER w AS total FROM scenes WINDOW w AS (PARTITION BY year(ts), month(ts)))
  WHERE cloud < 2 OR (clear < 4 AND total > clear)"""))
def _(v):
    dated = v.scenes.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    return scenes.adaptive_cloud(dated, 2, min_scenes=4).select("scene_id", "year", "month", "relaxed")


@query("s11_scene_gates", sql("obs", """SELECT CAST(year(day) AS INT) AS "year", count(DISTINCT scene_id // 10) AS scenes,
  round(avg(CASE WHEN scl IN (1, 3, 7) THEN 1.0 ELSE 0.0 END), 6) AS gap_share, count(DISTINCT scene_id // 10) >= 6 AS accepted,
  avg(CASE WHEN scl IN (1, 3, 7) THEN 1.0 ELSE 0.0 END) > 0.15 AS warn_gap FROM obs GROUP BY 1"""))
def _(v):
    seen = v.obs.select(
        F.year("day").alias("year"), F.expr("scene_id div 10").alias("scene_id"),
        F.when(scl_clear(F.col("scl"), (1, 3, 7)), ndvi(F.col("red"), F.col("nir"))).alias("value"),
    )
    gates = scenes.scene_gate(seen)
    return gates.withColumn("gap_share", r6("gap_share"))


# --- S12, S13: features ----------------------------------------------------------


@query("s12_tagged_features", """SELECT s_suppkey AS feature_id, CASE WHEN s_nationkey % 2 = 1 THEN 'polygon' ELSE 'line' END AS geom_type FROM supplier
  WHERE (s_suppkey % 4 IN (0, 1, 2) OR s_suppkey % 3 = 0) AND NOT s_suppkey % 4 IN (2, 3)""")
def _(v):
    groups = [{"waterway": ["river", "stream", "canal"]}, {"natural": ["water"]}, {"landuse": ["reservoir"]}]
    found = features.tagged_features(v.vectors, groups, exclude={"waterway": ["canal", "ditch", "drain"]})
    return found.select("feature_id", "geom_type")


def _inner(v):
    h = v.grid.height * RES
    return LEFT + 150.0, TOP - h * 0.9, LEFT + 1300.0, TOP - h * 0.1


@query("s13_line_network", sql("edges", f"""SELECT count(DISTINCT feature_id) AS features, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * (t1 - t0)) / 1000, 6) AS line_km FROM (
  SELECT *, greatest(0, least(tx0, tx1), least(ty0, ty1)) AS t0, least(1, greatest(tx0, tx1), greatest(ty0, ty1)) AS t1 FROM (
  SELECT *, ({LEFT} + 150.0 - x1) / (x2 - x1) AS tx0, ({LEFT} + 1300.0 - x1) / (x2 - x1) AS tx1,
  ({TOP} - h * {RES} * 0.9 - y1) / (y2 - y1) AS ty0, ({TOP} - h * {RES} * 0.1 - y1) / (y2 - y1) AS ty1
  FROM edges, dims WHERE geom_type = 'line')) WHERE t0 < t1"""))
def _(v):
    lines = v.vectors.where("geom_type = 'line'")
    return features.network_summary(lines, _inner(v)).select("features", r6("line_km").alias("line_km"))


@query("s13_polygon_network", sql("vectors", """SELECT count(*) AS features, round(sum(abs((b_x - a_x) * (c_y - a_y) - (c_x - a_x) * (b_y - a_y)) / 2) / 1e6, 6) AS polygon_km2
  FROM vectors WHERE geom_type = 'polygon'"""))
def _(v):
    rings = v.vectors.where("geom_type = 'polygon'")
    h = v.grid.height * RES
    whole = (LEFT - 1000, TOP - h - 1000, LEFT + WIDTH * RES + 1000, TOP + 1000)
    return features.network_summary(rings, whole).select("features", r6("polygon_km2").alias("polygon_km2"))


_CUT = f"""box AS (SELECT {LEFT} + 150.0 AS l, {LEFT} + 1300.0 AS r, {TOP} - h * {RES} * 0.9 AS b, h * {RES} * 0.8 AS z FROM dims),
ring AS (SELECT feature_id, m, z, y1 + m * (least(greatest(x1, l), r) - x1) - b AS ya, y1 + m * (least(greatest(x2, l), r) - x1) - b AS yb
  FROM (SELECT *, (y2 - y1) / (x2 - x1) AS m FROM edges WHERE geom_type = 'polygon'), box WHERE least(greatest(x1, l), r) <> least(greatest(x2, l), r)),
areas AS (SELECT feature_id, abs(sum(((CASE WHEN yb <= 0 THEN 0 WHEN yb <= z THEN yb * yb / 2 ELSE z * z / 2 + z * (yb - z) END)
  - (CASE WHEN ya <= 0 THEN 0 WHEN ya <= z THEN ya * ya / 2 ELSE z * z / 2 + z * (ya - z) END)) / m)) AS area FROM ring GROUP BY 1),
line_cut AS (SELECT feature_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * (t1 - t0) AS len FROM (SELECT *,
  greatest(0, least((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)), least((b - y1) / (y2 - y1), (b + z - y1) / (y2 - y1))) AS t0,
  least(1, greatest((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)), greatest((b - y1) / (y2 - y1), (b + z - y1) / (y2 - y1))) AS t1
  FROM edges, box WHERE geom_type = 'line') WHERE t0 < t1)"""


@query("s13_network_summary", sql("edges dims", """SELECT (SELECT count(*) FROM areas WHERE area > 1e-6) + (SELECT count(*) FROM line_cut) AS features,
  (SELECT round(sum(len) / 1000, 6) FROM line_cut) AS line_km, (SELECT round(sum(area) / 1e6, 6) FROM areas) AS polygon_km2""", _CUT))
def _(v):
    out = features.network_summary(v.vectors, _inner(v))
    return out.select("features", r6("line_km").alias("line_km"), r6("polygon_km2").alias("polygon_km2"))


# --- S14: JSON-stat -----------------------------------------------------------------


def _cubes(v):
    """One cube text per crop: statistic x crop x year, over all years of the table."""
    dated = v.crop.where("year IS NOT NULL")
    span = dated.agg(F.min("year").alias("first"), F.max("year").alias("last")).first()
    first, n = span["first"], span["last"] - span["first"] + 1
    entries = F.inline(
        F.array(
            F.struct((F.col("year") - first).cast("string").alias("k"), F.col("production").alias("w")),
            F.struct((F.col("year") - first + n).cast("string").alias("k"), F.col("area").alias("w")),
        )
    )
    index = lambda names: F.struct(F.struct(F.create_map(*[x for i, n in enumerate(names) for x in (n if not isinstance(n, str) else F.lit(n), F.lit(i))]).alias("index")).alias("category"))
    packed = dated.select("crop", entries).groupBy("crop").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "w")))).alias("value")
    )
    dimension = F.struct(
        index(["PR", "AR"]).alias("strucpro"), index([F.col("crop")]).alias("crops"), index([str(first + y) for y in range(n)]).alias("time")
    )
    return packed.select(
        "crop",
        F.to_json(F.struct(
            F.array(F.lit("strucpro"), F.lit("crops"), F.lit("time")).alias("id"),
            F.array(F.lit(2), F.lit(1), F.lit(n)).alias("size"), "value", dimension.alias("dimension"),
        )).alias("json"),
    )


@query("s14_jsonstat_cube", sql("crop", """SELECT crop AS cube, "year", production, area FROM crop
  WHERE "year" IS NOT NULL"""))
def _(v):
    cells = jsonstat.parse_cubes(_cubes(v).withColumnRenamed("crop", "cube"), keys=["cube"])
    named = cells.select(
        "cube", jsonstat.coordinate("strucpro").alias("crop"), jsonstat.coordinate("time").cast("int").alias("year"), "value"
    )
    wide = jsonstat.year_by_crop(named, ["PR", "AR"], keys=["cube"])
    return wide.select("cube", "year", F.col("PR").alias("production"), F.col("AR").alias("area"))


@query("s14_indicator_table", sql("crop", """SELECT crop AS cube, "year", 'c:' || crop AS crop, area AS value FROM crop
  WHERE "year" IS NOT NULL AND crop IN ('Brand#1', 'Brand#2', 'Brand#3')"""))
def _(v):
    cells = jsonstat.parse_cubes(_cubes(v).withColumnRenamed("crop", "cube"), keys=["cube"])
    wanted = {f"Brand#{k}": f"c:Brand#{k}" for k in (1, 2, 3)}
    return jsonstat.indicator_table(cells, "AR", wanted, keys=["cube"])


# --- S15, S16: survey -----------------------------------------------------------------


def _forms(v):
    """Filled questionnaires as text; every 7th respondent leaves one blank, every 11th one out of scale."""
    names = F.array(*[F.lit(n) for n in LABELS])
    answer = (
        F.when((F.col("respondent") % 7 == 0) & (F.col("i") == 0) & (F.col("j") == 3), "")
        .when((F.col("respondent") % 11 == 0) & (F.col("i") == 1) & (F.col("j") == 2), "12")
        .when(F.col("answer") % 2 == 0, F.concat(F.lit('"'), F.col("answer").cast("string"), F.lit(',0"')))
        .otherwise(F.col("answer").cast("string"))
    )
    line = F.concat_ws(",", (F.col("i") * 10 + F.col("j")).cast("string"), F.element_at(names, F.col("i") + 1), F.lit("a"), F.element_at(names, F.col("j") + 1), F.lit("b"), answer)
    head = "# survey, with a comma\n# no, not a header\n\nno,A_kod,A_aciklama,B_kod,B_aciklama,cevap\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", line.alias("line")))), lambda s: s["line"])
    return v.judgements.groupBy("respondent").agg(F.concat(F.lit(head), F.concat_ws("\n", lines), F.lit("\n# end\n")).alias("text"))


_ANSWER = """CASE WHEN respondent % 7 = 0 AND i = 0 AND j = 3 THEN NULL WHEN respondent % 11 = 0 AND i = 1 AND j = 2 THEN NULL
  WHEN answer > 0 THEN answer ELSE 1.0 / abs(answer) END"""


@query("s15_survey_scan", sql("judgements", f"SELECT respondent, i, j, round({_ANSWER}, 6) AS a FROM judgements"))
def _(v):
    answers = survey.parse_forms(_forms(v))
    return survey.judgements(answers, LABELS).withColumn("a", r6("a"))


@query("s15_survey_errors", """SELECT s_suppkey AS respondent, 'not answered' AS problem, 'precip' AS a_code, 'lst' AS b_code FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT s_suppkey, 'outside the scale', 'ndvi_dry', 'soil' FROM supplier WHERE s_suppkey % 11 = 0""")
def _(v):
    return survey.survey_errors(survey.parse_forms(_forms(v)), LABELS)


@query("s16_questionnaire", """WITH n AS (SELECT * FROM (VALUES (0,'precip'),(1,'ndvi_dry'),(2,'soil'),(3,'lst'),(4,'slope')) t(p, name))
  SELECT s_suppkey AS respondent, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY a.p, b.p) AS INT) AS no, a.name AS "A_kod", b.name AS "B_kod"
  FROM supplier, n a, n b WHERE a.p < b.p""")
def _(v):
    people = v.table("supplier").select(F.col("s_suppkey").alias("respondent"))
    return survey.questionnaire(people, LABELS).select("respondent", "no", "A_kod", "B_kod")


# --- S17-S19: periods and scenarios -----------------------------------------------------


@query("s17_period_discovery", sql("impact", 'SELECT DISTINCT "year" FROM impact'))
def _(v):
    return discover_periods(v.impact, ["year"])


@query("s18_missing_periods", """SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS "year", CAST(month(o_orderdate) AS INT) AS "month" FROM orders
  EXCEPT SELECT DISTINCT CAST(year(l_shipdate) AS INT), CAST(month(l_shipdate) AS INT) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09""")
def _(v):
    wanted = v.table("orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    done = v.table("lineitem").where("l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09")
    existing = done.select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return missing_periods(wanted, existing, ["year", "month"])


@query("s19_scenarios", sql("layers bounds", """SELECT s.scenario, cell_id, round(CASE WHEN s.up THEN c ELSE 1 - c END, 6) + 0.0 AS score
  FROM (SELECT cell_id, least(greatest((soil - soil_lo) / (soil_hi - soil_lo), 0), 1) AS c FROM layers, bounds),
  (VALUES ('steep_riskier', true), ('flat_riskier', false)) s(scenario, up)"""))
def _(v):
    low, high = percentile_bounds(v.layers, [c for c in CRITERIA if c.name == "soil"])["soil"]
    base = rescale(F.col("soil"), low, high)
    variants = F.array(*[
        F.struct(F.lit(name).alias("scenario"), directed(base, up).alias("score"))
        for name, up in (("steep_riskier", True), ("flat_riskier", False))
    ])
    return v.layers.select("cell_id", F.inline(variants)).select("scenario", "cell_id", r6("score").alias("score"))


# --- S20, S21 -------------------------------------------------------------------------


@query("s20_summary_export", sql("classes yearly", """SELECT class, label, pixels, round(share_pct, 1) AS share_pct, color, n_years FROM (
  SELECT class, ['very low','low','medium','high','very high'][class] AS label, count(*) AS pixels, 100.0 * count(*) / sum(count(*)) OVER () AS share_pct,
  ['#f2e6c8','#e3c48a','#c9944f','#96602f','#573516'][class] AS color FROM classes WHERE class > 0 GROUP BY class), (SELECT count(*) AS n_years FROM yearly)"""))
def _(v):
    from aridscape.operators.validate import yearly_test

    labels = {1: "very low", 2: "low", 3: "medium", 4: "high", 5: "very high"}
    colors = ["#f2e6c8", "#e3c48a", "#c9944f", "#96602f", "#573516"]
    records = export.class_records(class_summary(v.classes.select("class"), v.grid.cell_km2), v.breaks, labels, colors)
    years = yearly_test(v.joined, v.labels).select("year", "severity", "is_dry", "rho")
    text = export.summary_json(records, {"crs": CRS, "resolution_m": RES}, {"n_criteria": len(WEIGHTS)}, {"operational_years": years})
    schema = (
        "classification struct<classes: array<struct<class:int,label:string,upper_bound:double,pixels:bigint,share_pct:double,area_km2:double,color:string>>>, "
        "operational_years array<struct<year:int>>"
    )
    read = text.select(F.from_json("json", schema).alias("s"))
    return read.select(F.size("s.operational_years").cast("bigint").alias("n_years"), F.inline("s.classification.classes")).select(
        "class", "label", "pixels", "share_pct", "color", "n_years"
    )


@query("s21_area_of_interest", sql("filled", f"""SELECT DISTINCT cell_id FROM filled WHERE {LEFT} + (col + 0.5) * {RES} BETWEEN {LEFT} + 200.0 AND {LEFT} + 1200.0"""))
def _(v):
    rings = segments(v.vectors.where("geom_type = 'polygon'"), ["feature_id"])
    inside = filled_cells(rings, v.grid, ["feature_id"])
    box = (LEFT + 200.0, 0.0, LEFT + 1200.0, 1e7)
    return features.aoi_cells(v.located, bbox=box, inside=inside, lon="x", lat="y").select("cell_id")
