import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from aridscape.operators.classify import class_summary
from aridscape.sources import export, features, jsonstat, scenes, series
from tests.test_terrain import SPEC, square, vectors


def catalogue(spark, rows):
    return spark.createDataFrame(rows, scenes.SCENE_SCHEMA)


def scene(i, cloud=5.0, ts=dt.datetime(2024, 7, 31, 23, 0), **properties):
    return (i, "c", ts, cloud, 27.0, 38.0, 28.0, 39.0, {k: v for k, v in properties.items()}, {"red": (0.5, 1.0, 0.0)})


def test_scene_selection(spark):
    df = catalogue(spark, [scene("a"), scene("b", cloud=20.0), scene("c", ts=dt.datetime(2024, 8, 1)), scene("d")])
    found = scenes.select_scenes(df, collection="c", bbox=(27.9, 38.9, 29, 40), start="2024-07-01", end="2024-07-31", max_cloud=20)
    assert sorted(r["scene_id"] for r in found.collect()) == ["a", "d"]
    assert scenes.select_scenes(df, bbox=(29, 40, 30, 41)).isEmpty()


def test_platform_comes_from_the_id(spark):
    df = catalogue(spark, [scene("MOD11A2.1"), scene("MYD11A2.1")])
    assert [r["scene_id"] for r in scenes.platform_filter(df, "MYD11A2").collect()] == ["MYD11A2.1"]
    assert scenes.platform_filter(df, "both").count() == 2
    with pytest.raises(ValueError):
        scenes.platform_filter(df, "terra")


def test_edition_year_when_the_datetime_is_null(spark):
    df = catalogue(spark, [scene("a", ts=None, start_datetime="2021-01-01T00:00:00Z"), scene("b", ts=None)])
    assert {r[0]: r[1] for r in df.select("scene_id", scenes.edition_year()).collect()} == {"a": 2021, "b": None}


def test_band_metadata(spark):
    df = catalogue(spark, [scene("a")])
    assert tuple(df.select(*scenes.band_scaling("red")).first()) == (0.5, 1.0, 0.0)
    scenes.require_band_metadata(df, "red")
    with pytest.raises(ValueError, match="no scaling metadata"):
        scenes.require_band_metadata(df, "nir")


def test_cloud_limit_relaxes_only_where_it_helps(spark):
    rows = [(1, 1, float(c)) for c in (5, 50, 60)] + [(1, 2, 5.0)] * 4 + [(1, 2, 90.0)] + [(1, 3, 5.0)]
    df = spark.createDataFrame(rows, "year int, month int, cloud double")
    got = scenes.adaptive_cloud(df, 20).groupBy("month").agg(F.count("*").alias("n"), F.max("relaxed").alias("r")).collect()
    assert {r["month"]: (r["n"], r["r"]) for r in got} == {1: (3, True), 2: (4, False), 3: (1, False)}


def test_series_gates(spark):
    rows = [(2000, s, None if s == 1 else 0.5) for s in range(6)] + [(2001, s, 0.5) for s in range(5)]
    got = {r["year"]: r for r in scenes.scene_gate(spark.createDataFrame(rows, "year int, scene_id int, value double")).collect()}
    assert got[2000]["accepted"] and got[2000]["warn_gap"] and not got[2001]["accepted"]
    with pytest.raises(ValueError, match="only 2"):
        scenes.require_series(spark.range(2))


def test_region_mean_equals_a_plain_filter(spark):
    grid = spark.range(900).select(
        (F.lit(26.0) + (F.col("id") % 30) * 0.1 + 0.05).alias("lon"), (F.lit(39.0) - F.expr("id div 30") * 0.1 - 0.05).alias("lat"),
        F.lit("2020-01-01").cast("date").alias("month"), F.col("id").cast("double").alias("value"),
    )
    boxes = spark.createDataFrame([(1, 26.2, 37.0, 27.8, 38.6), (2, 26.0, 38.5, 26.4, 39.0)], "region_id int, west double, south double, east double, north double")
    got = {r["region_id"]: r["ppt"] for r in series.region_mean(grid, "ppt", boxes).collect()}
    for r in boxes.collect():
        inside = grid.where(F.col("lon").between(r["west"], r["east"]) & F.col("lat").between(r["south"], r["north"]))
        assert got[r["region_id"]] == pytest.approx(inside.agg(F.avg("value")).first()[0])


def test_region_mean_with_all_points_in_one_place(spark):
    """Crowded inner cells, crowded edge cells, points on the bounds, gaps and boxes within one cell."""
    lon = F.element_at(F.array(*[F.lit(x) for x in (26.0, 26.2, 26.9, 27.3, 27.8, 27.81)]), (F.col("id") % 6 + 1).cast("int"))
    grid = spark.range(3000).select(
        lon.alias("lon"), F.when(F.col("id") % 2 == 0, 38.0).otherwise(38.6).alias("lat"), F.lit("2020-01-01").cast("date").alias("month"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"),
    )
    rows = [(1, 26.2, 37.0, 27.8, 38.6), (2, 26.0, 38.0, 26.0, 38.0), (3, 26.85, 37.95, 26.95, 38.05), (4, -5.0, 10.0, 60.0, 70.0), (5, 1.0, 1.0, 2.0, 2.0)]
    boxes = spark.createDataFrame(rows, "region_id int, west double, south double, east double, north double")
    got = {r["region_id"]: r["ppt"] for r in series.region_mean(grid, "ppt", boxes).collect()}
    assert set(got) == {1, 2, 3, 4}
    for r in boxes.where("region_id < 5").collect():
        inside = grid.where(F.col("lon").between(r["west"], r["east"]) & F.col("lat").between(r["south"], r["north"]))
        assert got[r["region_id"]] == pytest.approx(inside.agg(F.avg("value")).first()[0])


def test_variables_with_missing_tails(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "region_id int, month int, ppt double")
    b = spark.createDataFrame([(1, 1, 7.0)], "region_id int, month int, soil double")
    rows = {r["month"]: (r["ppt"], r["soil"]) for r in series.combine_variables({"ppt": a, "soil": b}).collect()}
    assert rows == {1: (5.0, 7.0), 2: (6.0, None)}
    with pytest.raises(ValueError):
        series.combine_variables({})
    with pytest.raises(ValueError):
        series.concat_years([])


def test_monthly_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,ppt,soil\n1958-01-01,10.5,\n1958-02-01,3,7\n")
    got = series.read_monthly_csv(spark, str(tmp_path / "s.csv"), ["ppt", "soil"]).orderBy("month").collect()
    assert (got[0]["month"], got[0]["soil"], got[1]["ppt"]) == (dt.date(1958, 1, 1), None, 3.0)
    with pytest.raises(FileNotFoundError):
        series.read_monthly_csv(spark, str(tmp_path / "none.csv"), ["ppt"])


# --- features -------------------------------------------------------------------------


def test_tag_groups_and_exclusions(spark):
    df = vectors(spark, [
        (1, "line", 0, [(0.0, 0.0), (1.0, 1.0)], {"waterway": "river"}), (2, "line", 0, [(0.0, 0.0), (1.0, 1.0)], {"waterway": "canal"}),
        (3, "polygon", 0, square(0.0, 0.0, 1.0, 1.0), {"natural": "water"}), (4, "line", 0, [(0.0, 0.0), (1.0, 1.0)], {"highway": "road"}),
    ])
    groups = [{"waterway": ["river", "canal"]}, {"natural": ["water"]}]
    found = features.tagged_features(df, groups, exclude={"waterway": ["canal"]})
    assert sorted(r["feature_id"] for r in found.collect()) == [1, 3]
    with pytest.raises(RuntimeError, match="could not be read"):
        features.tagged_features(df, groups, failed=["natural=water"])


def test_network_is_clipped(spark):
    df = vectors(spark, [
        (1, "line", 0, [(-50.0, 40.0), (170.0, 40.0)], {}), (2, "line", 0, [(200.0, 0.0), (300.0, 10.0)], {}),
        (3, "polygon", 0, square(100.0, 60.0, 140.0, 100.0), {}), (4, "polygon", 0, square(20.0, 20.0, 60.0, 60.0), {}),
        (4, "polygon", 1, square(30.0, 30.0, 40.0, 40.0)[::-1], {}), (5, "polygon", 0, [(-20.0, 40.0), (0.0, 60.0), (20.0, 40.0), (0.0, 20.0), (-20.0, 40.0)], {}),
    ])
    out = features.network_summary(df, SPEC.bounds).first()
    assert out["features"] == 4
    assert out["line_km"] == pytest.approx(0.12)
    assert out["polygon_km2"] * 1e6 == pytest.approx(20 * 20 + (1600 - 100) + 400)


def test_area_of_interest_must_not_be_empty(spark):
    cells = spark.createDataFrame([(0, 0, 27.0, 38.0)], "row int, col int, lon double, lat double")
    assert features.aoi_cells(cells, bbox=(26, 37, 28, 39)).count() == 1
    with pytest.raises(ValueError, match="do not intersect"):
        features.aoi_cells(cells, bbox=(0, 0, 1, 1))


# --- JSON ------------------------------------------------------------------------------


def test_jsonstat_strides(spark):
    cube = {
        "id": ["strucpro", "crops", "geo", "time"], "size": [2, 2, 1, 3],
        "dimension": {
            "strucpro": {"category": {"index": {"PR": 0, "AR": 1}}}, "crops": {"category": {"index": {"C0000": 0, "I1150": 1}}},
            "geo": {"category": {"index": {"TR33": 0}}}, "time": {"category": {"index": {"2000": 0, "2001": 1, "2002": 2}}},
        },
        "value": {"0": 10, "2": 12.5, "4": 7, "7": 99},
    }
    loose = {k: v for k, v in cube.items() if k != "size"}
    for body in (cube, loose):
        cells = jsonstat.parse_cubes(spark.createDataFrame([(json.dumps(body),)], "json string"))
        table = jsonstat.indicator_table(cells, "PR", {"C0000": "tahil", "I1150": "pamuk_lifi"})
        assert {(r["year"], r["crop"]): r["value"] for r in table.collect()} == {(2000, "tahil"): 10.0, (2002, "tahil"): 12.5, (2001, "pamuk_lifi"): 7.0}
        wide = {r["year"]: (r["tahil"], r["pamuk_lifi"]) for r in jsonstat.year_by_crop(table, ["tahil", "pamuk_lifi"]).collect()}
        assert wide[2001] == (None, 7.0)


def test_summary_json(spark, tmp_path):
    classes = spark.createDataFrame([(c,) for c in [0, 1, 1, 2, 2, 2]], "class int")
    records = export.class_records(class_summary(classes, 0.0009), [0.3, 0.9], {1: "low", 2: "high"}, ["#111111", "#222222"])
    stale = export.class_records(class_summary(classes, 0.0009), [0.3, 0.9], {1: "low", 2: "high"}, ["#1", "#2"], bounds_stale=F.lit(True))
    years = spark.createDataFrame([(2001, -0.2)], "year int, rho double")
    text = export.summary_json(records, {"crs": "EPSG:32635"}, {"n_criteria": 9}, {"years": years})
    export.write_summary(text, str(tmp_path / "out"))
    body = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert body["grid"]["crs"] == "EPSG:32635" and body["ahp"]["n_criteria"] == 9
    assert [c["upper_bound"] for c in body["classification"]["classes"]] == [0.3, 0.9]
    assert body["classification"]["classes"][1]["share_pct"] == 60.0 and body["years"][0]["year"] == 2001
    assert stale.where("upper_bound IS NOT NULL").isEmpty()
