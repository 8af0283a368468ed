"""Composites and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aridscape.operators import composites as C
from aridscape.operators import keyed as G
from aridscape.operators import normalize as N
from aridscape.sources.scenes import band_scaling

from registry.views import CRITERIA, NAMES, query, r6, r9, sql

_CLEAR = "scl NOT IN (1, 3, 7)"
_NDVI = "CASE WHEN nir + red > 0 AND (nir - red) / (nir + red) BETWEEN -1 AND 1 THEN (nir - red) / (nir + red) END"


@query("r01_scene_class_mask", sql("obs", "SELECT scl, scl NOT IN (0, 1, 3, 7, 8, 9, 10, 11) AS clear, count(*) AS n FROM obs GROUP BY 1, 2"))
def _(v):
    return v.obs.groupBy("scl", C.scl_clear(F.col("scl")).alias("clear")).agg(F.count("*").alias("n"))


@query("r02_qa_bits", sql("obs", "SELECT qa, (qa & 59) = 0 AS clear, count(*) AS n FROM obs GROUP BY 1, 2"))
def _(v):
    return v.obs.groupBy("qa", C.qa_clear(F.col("qa")).alias("clear")).agg(F.count("*").alias("n"))


@query("r03_baseline_offset", sql("scenes", "SELECT scene_id, CASE WHEN TRY_CAST(baseline AS DOUBLE) >= 4 THEN -1000.0 ELSE 0.0 END::DOUBLE AS dn_offset FROM scenes"))
def _(v):
    from aridscape.sources.scenes import property_of

    return v.scenes.select("scene_id", C.baseline_offset(property_of("s2:processing_baseline")).alias("dn_offset"))


@query("r04_reflectance", """SELECT l_orderkey AS scene, l_linenumber AS line, l_partkey AS cell_id, round((l_quantity * 200 + CASE WHEN l_linenumber >= 4 THEN -1000 ELSE 0 END) / 10000, 6) AS optical,
  round(CASE WHEN l_quantity <> 1 THEN l_quantity * 0.0000275 - 0.2 END, 6) AS scaled FROM lineitem""")
def _(v):
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    info = F.create_map(F.lit("red"), F.struct(F.lit(0.0000275).alias("scale"), F.lit(-0.2).alias("offset"), F.lit(1.0).alias("nodata")))
    scale, offset, fill = band_scaling("red")
    shift = C.baseline_offset(F.col("l_linenumber").cast("string"))
    return lines.withColumn("bands", info).select(
        F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("cell_id"),
        r6(C.reflectance(F.col("l_quantity") * 200, shift)).alias("optical"),
        r6(C.scaled(F.col("l_quantity"), scale, offset, fill)).alias("scaled"),
    )


@query("r05_ndvi", sql("obs", f"SELECT scene_id, cell_id, round({_NDVI}, 6) AS ndvi FROM obs"))
def _(v):
    return v.obs.select("scene_id", "cell_id", r6(C.ndvi(F.col("red"), F.col("nir"))).alias("ndvi"))


@query("r06_evi", sql("obs", """SELECT scene_id, cell_id, round(CASE WHEN den > 0 AND 2.5 * (nir - red) / den BETWEEN -1 AND 1 THEN 2.5 * (nir - red) / den END, 6) AS evi
  FROM (SELECT *, nir + 6 * red - 7.5 * blue + 1 AS den FROM obs)"""))
def _(v):
    return v.obs.select("scene_id", "cell_id", r6(C.evi(F.col("red"), F.col("nir"), F.col("blue"))).alias("evi"))


@query("r07_monthly_median", sql("monthly", 'SELECT cell_id, "year", "month", value FROM monthly'))
def _(v):
    return v.monthly.select("cell_id", "year", "month", "value")


@query("r08_dry_season", sql("monthly", 'SELECT cell_id, round(median(value), 6) AS value FROM monthly WHERE "month" IN (7, 8, 9) GROUP BY 1'))
def _(v):
    return C.season_median(v.monthly, C.month_range(7, 9)).select("cell_id", r6("value").alias("value"))


@query("r09_year_series", sql("monthly", 'SELECT "month", count(value) AS cells, round(avg(value), 6) AS mean FROM monthly WHERE "year" = 1998 GROUP BY 1'))
def _(v):
    year = v.obs.where(F.year("day") == 1998).where(C.scl_clear(F.col("scl"), (1, 3, 7)))
    monthly = C.monthly_median(year.withColumn("i", C.ndvi(F.col("red"), F.col("nir"))), "i").withColumn("value", r9(F.col("value")))
    return monthly.groupBy("month").agg(F.count("value").alias("cells"), r6(F.avg("value")).alias("mean"))


@query("r10_modis_lst", """SELECT l_partkey AS cell_id, round(avg(CASE WHEN l_quantity * 400 BETWEEN 7500 AND 65535 THEN l_quantity * 400 * 0.02 - 273.15 END), 6) AS lst
  FROM lineitem WHERE month(l_shipdate) IN (7, 8, 9) GROUP BY 1""")
def _(v):
    raw = v.table("lineitem").select(F.col("l_partkey").alias("cell_id"), (F.col("l_quantity") * 400).alias("raw"), F.col("l_shipdate").cast("date").alias("day"))
    out = C.season_mean(raw, C.modis_celsius(F.col("raw")), C.month_range(7, 9), by=["cell_id"], output="lst")
    return out.withColumn("lst", r6("lst"))


@query("r11_landsat_lst", """SELECT l_partkey AS cell_id, CAST(year(l_shipdate) AS INT) AS "year", round(median(CASE WHEN c > -20 AND c < 75 THEN c END), 6) AS lst FROM (
  SELECT *, CASE WHEN l_quantity <> 1 THEN l_quantity * 3.5 + 149.0 END - 273.15 + 100 * l_discount + 60 AS c FROM lineitem WHERE (CAST(l_quantity AS INT) & 59) IN (0, 1, 2, 3)) GROUP BY 1, 2""")
def _(v):
    lines = v.table("lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_discount")
    kept = lines.where(F.col("l_quantity").cast("int").bitwiseAND(F.lit(59)).isin(0, 1, 2, 3))
    # a per-row offset plays the scene metadata
    offset = F.lit(149.0) + 100 * F.col("l_discount") + 60
    celsius = C.landsat_celsius(F.col("l_quantity"), F.lit(3.5), offset, F.lit(1.0))
    return (
        kept.withColumn("c", celsius).groupBy(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year"))
        .agg(r6(F.median("c")).alias("lst"))
    )


_ET = "CASE WHEN l_quantity * 700 < 32700 THEN l_quantity * 70 END / CASE WHEN l_discount * 1000 * 0.1 > 1 THEN l_discount * 1000 * 0.1 END"


@query("r12_et_ratio", f"SELECT l_partkey AS cell_id, round(avg({_ET}), 9) AS ratio FROM lineitem GROUP BY 1")
def _(v):
    ratio = C.evaporation_ratio(F.col("l_quantity") * 700, F.col("l_discount") * 1000)
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(r9(F.avg(ratio)).alias("ratio"))


@query("r12_et_ratio_yearly", f'SELECT l_partkey AS cell_id, CAST(year(l_shipdate) AS INT) AS "year", round(avg({_ET}), 9) AS ratio FROM lineitem GROUP BY 1, 2')
def _(v):
    ratio = C.evaporation_ratio(F.col("l_quantity") * 700, F.col("l_discount") * 1000)
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year")).agg(r9(F.avg(ratio)).alias("ratio"))


@query("r13_rainfall_normal", sql("climate", """SELECT region_id, round(avg(total), 6) AS precip FROM (SELECT region_id, CASE WHEN count(p) = 3 THEN sum(p) END AS total FROM (
  SELECT region_id, year("month") AS y, CASE WHEN ppt - 1 >= 0 THEN ppt - 1 END AS p FROM climate WHERE month("month") IN (7, 8, 9)) GROUP BY region_id, y) GROUP BY 1"""))
def _(v):
    monthly = v.climate.select("region_id", F.year("month").alias("year"), F.month("month").alias("month"), (F.col("ppt") - 1).alias("rain"))
    return C.seasonal_rain_normal(monthly, "rain", C.month_range(7, 9), cell=["region_id"]).withColumn("precip", r6("precip"))


@query("r14_water_capacity", """SELECT l_partkey AS cell_id, round(sum(awc * th) / sum(CASE WHEN awc IS NOT NULL THEN th END), 9) AS awc FROM (
  SELECT l_partkey, [5.0, 10.0, 15.0][l_linenumber % 3 + 1] AS th, CASE WHEN f - w >= 0 THEN f - w END AS awc FROM (
  SELECT *, CASE WHEN l_quantity - 1 <> 0 THEN (l_quantity - 1) * 0.001 END AS f, CASE WHEN l_discount * 200 <> 0 THEN l_discount * 200 * 0.001 END AS w FROM lineitem)) GROUP BY 1""")
def _(v):
    depths = v.table("lineitem").select(
        F.col("l_partkey").alias("cell_id"), (F.col("l_quantity") - 1).alias("field_capacity"), (F.col("l_discount") * 200).alias("wilting_point"),
        F.element_at(F.array(F.lit(5.0), F.lit(10.0), F.lit(15.0)), F.col("l_linenumber") % 3 + 1).alias("thickness"),
    )
    return C.water_capacity(depths).withColumn("awc", r9(F.col("awc")))


@query("r15_clean_elevation", sql("cells", "SELECT cell_id, CASE WHEN elev - 2000 >= -1000 THEN elev END AS elev FROM cells"))
def _(v):
    return v.cells.select("cell_id", F.when(C.clean_elevation(F.col("elev") - 2000).isNotNull(), F.col("elev")).alias("elev"))


@query("r16_landcover_report", sql("cells landcover", """SELECT lc AS code, name, count(*) AS cells, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
  FROM cells LEFT JOIN landcover ON code = lc GROUP BY 1, 2"""))
def _(v):
    codes = v.cells.select(F.col("lc").alias("code"))
    scored = N.lookup_scores(codes, v.landcover)
    counted = scored.groupBy("code").agg(F.count("*").alias("cells"))
    total = v.n_cells
    return counted.join(v.landcover.select("code", "name"), "code", "left").withColumn("share_pct", r6(100.0 * F.col("cells") / total))


@query("r17_seasonal_amplitude", sql("monthly", """SELECT cell_id, round(max(value) FILTER ("month" IN (3, 4, 5)) - min(value) FILTER ("month" IN (7, 8, 9)), 6) + 0.0 AS amplitude FROM monthly GROUP BY 1"""))
def _(v):
    return C.seasonal_amplitude(v.monthly, "value", C.month_range(3, 5), C.month_range(7, 9)).withColumn("amplitude", r6("amplitude"))


@query("r18_month_bounds", """SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS "year", CAST(month(o_orderdate) AS INT) AS "month", CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day,
  last_day(o_orderdate) AS final_day FROM orders WHERE month(o_orderdate) BETWEEN 7 AND 9""")
def _(v):
    first, last = C.month_bounds(F.col("year"), F.col("month"))
    periods = v.table("orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return periods.where(F.col("month").isin(*C.month_range(7, 9))).withColumns({"first_day": first, "final_day": last})


# --- normalisation --------------------------------------------------------------


@query("n01_percentile_minmax", sql("scores", "SELECT cell_id, precip, ndvi_dry, soil, lst FROM scores"))
def _(v):
    return v.scores


@query("n02_log_percentile", sql("layers", """SELECT cell_id, round(least(greatest((ln(1 + precip) - lo) / (hi - lo), 0), 1), 6) + 0.0 AS precip FROM layers,
  (SELECT quantile_cont(ln(1 + precip), 0.02) AS lo, quantile_cont(ln(1 + precip), 0.98) AS hi FROM layers)"""))
def _(v):
    spec = N.Criterion("precip", "minmax_percentile", True, log_transform=True)
    return N.score_layers(v.layers, [spec]).withColumn("precip", r6("precip"))


@query("n03_capped_minmax", sql("distance", "SELECT cell_id, round(least(greatest(distance_m / 150.0, 0), 1), 6) + 0.0 AS distance_m FROM distance"))
def _(v):
    spec = N.Criterion("distance_m", "minmax_capped", True, cap=150.0)
    return N.score_layers(v.distance, [spec]).withColumn("distance_m", r6("distance_m"))


@query("n04_pass_through", sql("layers", "SELECT cell_id, ndvi_dry FROM layers"))
def _(v):
    return N.score_layers(v.layers, [N.Criterion("ndvi_dry", "none", True)])


@query("n05_direction", sql("layers", "SELECT cell_id, round(1 - ndvi_dry, 6) AS ndvi_dry FROM layers"))
def _(v):
    return N.score_layers(v.layers, [N.Criterion("ndvi_dry", "none", False)]).withColumn("ndvi_dry", r6("ndvi_dry"))


@query("n06_lookup_score", sql("cells landcover", "SELECT cell_id, CAST(score AS DOUBLE) AS score FROM cells LEFT JOIN landcover ON code = lc"))
def _(v):
    return N.lookup_scores(v.cells.select("cell_id", F.col("lc").alias("code")), v.landcover).select("cell_id", "score")


def _profile_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS layer, round(avg({n}), 6) AS mean, round(quantile_cont({n}, 0.5), 6) AS median, round(quantile_cont({n}, 0.1), 6) AS p10,
        round(quantile_cont({n}, 0.9), 6) AS p90, round(min({n}), 6) AS "min", round(max({n}), 6) AS "max", round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS masked_share FROM layers"""
        for n in NAMES
    )


@query("n07_layer_profile", sql("layers", _profile_sql()))
def _(v):
    out = N.profile(v.layers, NAMES)
    return out.select("layer", *[r6(c).alias(c) for c in out.columns if c != "layer"])


@query("n08_criterion_build", sql("scores cells landcover", """SELECT s.cell_id, precip, ndvi_dry, soil, lst, CAST(score AS DOUBLE) AS landcover FROM scores s JOIN cells c USING (cell_id) LEFT JOIN landcover ON code = lc"""))
def _(v):
    aligned = v.layers.join(v.cells.select("cell_id", F.col("lc").alias("code")), "cell_id").join(v.landcover.select("code", "score"), "code", "left")
    builders = {n: (lambda df, n=n: F.col(n)) for n in NAMES} | {"landcover": lambda df: F.col("score")}
    criteria = [*CRITERIA, N.Criterion("landcover", "lookup", True)]
    built = N.build_criteria(aligned, criteria, builders=builders)
    return built.select("cell_id", *[r9(F.col(n)).alias(n) for n in (*NAMES, "landcover")])


@query("n01_percentile_minmax_by_grid", sql("grisk", "SELECT grid, cell_id, precip, ndvi_dry, soil, lst FROM grisk"))
def _(v):
    return v.grid_risk.drop("risk")


@query("n07_layer_profile_by_grid", sql("glayers", _profile_sql().replace("SELECT '", "SELECT grid, '").replace("FROM layers", "FROM glayers GROUP BY grid")))
def _(v):
    out = G.profile_by(v.grid_layers, NAMES, ["grid"])
    return out.select("grid", "layer", *[r6(c).alias(c) for c in out.columns if c not in ("grid", "layer")])
