import numpy as np
import pytest
from pyspark.sql import functions as F

from aridscape.functions.geodesy import with_lonlat, with_utm
from aridscape.operators.regrid import SourceRaster, regrid
from aridscape.sources import grid as G

SPEC = G.GridSpec("EPSG:32635", 30.0, 20, 12, 480000.0, 4290000.0)


def test_published_bounds_are_reproduced(spark):
    built = G.build_grid(spark, [27.60, 38.20, 28.60, 38.70], "EPSG:32635", 30)
    assert (built.left, built.top, built.width, built.height) == (552150.0, 4284720.0, 2932, 1885)


def test_grid_guards(spark):
    with pytest.raises(ValueError):
        G.GridSpec("EPSG:32635", 30.0, 0, 5, 0.0, 0.0)
    with pytest.raises(ValueError):
        G.build_grid(spark, [27.0, 38.0, 28.0], "EPSG:32635", 30)


def test_definition_roundtrip(spark, tmp_path):
    G.save_grid(spark, SPEC, str(tmp_path / "grid"))
    assert G.load_grid(spark, str(tmp_path / "grid")) == SPEC
    with pytest.raises(FileNotFoundError, match="run the grid step"):
        G.load_grid(spark, str(tmp_path / "missing"))


def test_cells_cover_the_grid(spark):
    cells = G.cells(spark, SPEC, tile=8)
    row = cells.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y0"), F.countDistinct("tile").alias("t")).first()
    assert (row["n"], row["x0"], row["y0"], row["t"]) == (240, 480015.0, 4289985.0, 6)


def test_layer_write_and_aligned_scan(spark, tmp_path):
    layer = G.cells(spark, SPEC).select("cell_id", F.when(F.col("col") > 0, F.col("row") / 3).alias("value"))
    path = str(tmp_path / "layer")
    G.write_layer(layer, SPEC, path, description="test")
    back = G.aligned_scan(spark, path, SPEC)
    assert back.where("value IS NULL").count() == 12
    assert back.agg(F.max("value")).first()[0] == pytest.approx(11 / 3, rel=1e-6)
    other = G.GridSpec("EPSG:32635", 30.0, 20, 12, 480030.0, 4290000.0)
    with pytest.raises(ValueError, match="not aligned"):
        G.aligned_scan(spark, path, other)


def test_incomplete_layer_is_rejected(spark, tmp_path):
    layer = G.cells(spark, SPEC).where("cell_id <> 7").select("cell_id", F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="distinct cells"):
        G.write_layer(layer, SPEC, str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError, match="no checked layer"):
        G.aligned_scan(spark, str(tmp_path / "bad"), SPEC)
    twice = layer.union(layer.where("cell_id = 8"))
    with pytest.raises(ValueError, match="distinct cells"):
        G.write_layer(twice, SPEC, str(tmp_path / "twice"))


def test_class_layers_take_eight_bits_and_reads_shuffle_nothing(spark, tmp_path):
    path = str(tmp_path / "classes")
    codes = G.cells(spark, SPEC).select("cell_id", F.when(F.col("col") > 0, F.col("row") * 10).alias("value"))
    G.write_layer(codes, SPEC, path, kind="class")
    assert spark.read.parquet(path).schema["value"].dataType.simpleString() == "tinyint"
    assert G.layer_manifest(spark, path)["rows"] == SPEC.cell_count
    back = G.aligned_scan(spark, path, SPEC)
    assert {r["value"] for r in back.select("value").distinct().collect()} == {None, *range(10, 120, 10)}
    assert "Exchange" not in back._jdf.queryExecution().toString()


def test_only_present_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "periods")
    base = G.cells(spark, SPEC).select("cell_id", F.explode(F.array(F.lit(2001), F.lit(2002))).alias("year"), F.lit(1.0).alias("value"))
    G.write_periods(base, path, ["year"])
    G.write_periods(base.where("year = 2002").withColumn("value", F.lit(9.0)), path, ["year"])
    stored = spark.read.parquet(path)
    assert {r["year"]: r["m"] for r in stored.groupBy("year").agg(F.max("value").alias("m")).collect()} == {2001: 1.0, 2002: 9.0}
    wanted = spark.createDataFrame([(y,) for y in range(2000, 2004)], "year int")
    assert sorted(r["year"] for r in G.missing_periods(wanted, G.discover_periods(stored, ["year"]), ["year"]).collect()) == [2000, 2003]


def test_projection_inverts_itself(spark):
    points = spark.range(200).select((F.lit(24.1) + F.col("id") * 0.029).alias("lon"), (F.lit(36.0) + F.col("id") * 0.021).alias("lat"))
    back = with_lonlat(with_utm(points, "lon", "lat", "EPSG:32635"), "x", "y", "EPSG:32635", "lon2", "lat2")
    gap = back.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))), F.max(F.abs(F.col("lat") - F.col("lat2")))).first()
    assert max(gap) < 1e-10


def test_regrid_from_lonlat_reproduces_a_plane(spark):
    """A field linear in lon and lat survives bilinear and cubic interpolation."""
    raster = SourceRaster(26.7, 38.85, 0.001, 0.001, 120, 120)
    source = spark.range(120 * 120).select(
        F.expr("id div 120").alias("row"), (F.col("id") % 120).alias("col")
    ).withColumn("value", 3 * (26.7 + (F.col("col") + 0.5) * 0.001) + 2 * (38.85 - (F.col("row") + 0.5) * 0.001))
    cells = G.cells(spark, SPEC)
    truth = with_lonlat(cells, "x", "y", SPEC.crs).select("cell_id", (3 * F.col("lon") + 2 * F.col("lat")).alias("t"))
    for method in ("bilinear", "cubic"):
        out = regrid(source, cells, SPEC, raster, method).join(truth, "cell_id")
        row = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("value") - F.col("t"))).alias("e")).first()
        assert row["n"] == SPEC.cell_count and row["e"] < 1e-9


def test_categories_are_never_interpolated(spark):
    raster = SourceRaster(0, 0, 1, 1, 2, 2, SPEC.crs)
    empty = spark.createDataFrame([], "row long, col long, value double")
    with pytest.raises(ValueError, match="invent class codes"):
        regrid(empty, G.cells(spark, SPEC), SPEC, raster, "bilinear", categorical=True)
    with pytest.raises(ValueError, match="unknown resampling"):
        regrid(empty, G.cells(spark, SPEC), SPEC, raster, "lanczos")


def test_mode_breaks_ties_to_the_lowest_code(spark):
    raster = SourceRaster(SPEC.left, SPEC.top, 15.0, 15.0, 4, 2, SPEC.crs)
    source = spark.createDataFrame([(0, 0, 7), (0, 1, 3), (1, 0, 3), (1, 1, 7), (0, 2, 5)], "row long, col long, value int")
    got = {r["cell_id"]: r["value"] for r in regrid(source, G.cells(spark, SPEC), SPEC, raster, "mode", categorical=True).collect()}
    assert got == {0: 3, 1: 5}


def test_aggregates_weigh_by_area_and_fill_a_finer_target(spark):
    n = 12
    raster = SourceRaster(SPEC.left - 10.0, SPEC.top + 20.0, 45.0, 45.0, n, n, SPEC.crs)
    values = np.random.default_rng(6).random((n, n))
    source = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(n) for c in range(n)], "row long, col long, value double")
    cells = G.cells(spark, SPEC)
    inside = {(i, j) for i in range(SPEC.height) for j in range(SPEC.width) if 30 * (i + 1) + 20 <= 45 * n and 30 * (j + 1) + 10 <= 45 * n}
    for method in ("average", "max", "min"):
        got = {divmod(r["cell_id"], SPEC.width): r["value"] for r in regrid(source, cells, SPEC, raster, method).collect()}
        assert inside <= set(got)
        for i, j in inside:
            r0, c0 = (30 * i + 20) / 45, (30 * j + 10) / 45
            parts = [
                ((min(r + 1, r0 + 2 / 3) - max(r, r0)) * (min(c + 1, c0 + 2 / 3) - max(c, c0)), values[r, c])
                for r in range(int(r0), min(n, int(r0 + 2 / 3 - 1e-9) + 1))
                for c in range(int(c0), min(n, int(c0 + 2 / 3 - 1e-9) + 1))
            ]
            want = {"average": sum(w * v for w, v in parts) / sum(w for w, _ in parts), "max": max(v for _, v in parts), "min": min(v for _, v in parts)}
            assert got[i, j] == pytest.approx(want[method])


def test_a_full_period_is_written_by_several_tasks(spark, tmp_path):
    from aridscape.sources.grid import write_periods

    path, name = str(tmp_path / "periods"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(200_000, numPartitions=8).select((F.col("id") % 1000).alias("cell_id"), F.lit(1998).alias("year"), F.rand(1).alias("value"))
    spark.conf.set(name, "256k")
    try:
        write_periods(rows, path, ["year"])
    finally:
        spark.conf.unset(name)
    assert len(list((tmp_path / "periods" / "year=1998").glob("*.parquet"))) > 1
    assert spark.read.parquet(path).count() == 200_000
