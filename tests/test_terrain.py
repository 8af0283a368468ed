import functools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import terrain as T
from aridscape.operators.distance import euclidean_distance, filled_cells, rasterize, require_features, segments
from aridscape.sources.grid import GridSpec, block_id, decimate


def frame(spark, z):
    h, w = z.shape
    rows, cols = np.mgrid[0:h, 0:w]
    pdf = pd.DataFrame({"cell_id": np.arange(h * w), "row": rows.ravel(), "col": cols.ravel(), "z": z.ravel().astype(float)})
    df = spark.createDataFrame(pdf)
    return df.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def gather(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", column).collect():
        out[r["row"], r["col"]] = np.nan if r[column] is None else r[column]
    return out


def numpy_horn(z, cell):
    p = np.pad(z, 1, mode="edge")
    k = lambda dr, dc: p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc]
    east = (k(-1, 1) + 2 * k(0, 1) + k(1, 1) - k(-1, -1) - 2 * k(0, -1) - k(1, -1)) / (8 * cell)
    north = (k(-1, -1) + 2 * k(-1, 0) + k(-1, 1) - k(1, -1) - 2 * k(1, 0) - k(1, 1)) / (8 * cell)
    return east, north


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_horn_equals_numpy_for_any_tiling(spark, tile):
    z = np.random.default_rng(0).normal(size=(13, 17)) * 50
    out = T.horn_gradients(frame(spark, z), "z", 30.0, tile=tile)
    assert out.count() == z.size
    east, north = numpy_horn(z, 30.0)
    np.testing.assert_allclose(gather(out, "dz_east", z.shape), east, atol=1e-12)
    np.testing.assert_allclose(gather(out, "dz_north", z.shape), north, atol=1e-12)


@pytest.mark.parametrize("east,north,aspect", [(1, 0, 270), (-1, 0, 90), (0, 1, 180), (0, -1, 0)])
def test_planes_have_known_slope_and_aspect(spark, east, north, aspect):
    rows, cols = np.mgrid[0:9, 0:9]
    z = 100 + 30.0 * (cols * east - rows * north)
    out = T.horn_gradients(frame(spark, z), "z", 30.0)
    slope = T.slope_degrees(F.col("dz_east"), F.col("dz_north"))
    direction = T.aspect_degrees(F.col("dz_east"), F.col("dz_north"))
    row = out.where("row = 4 AND col = 4").select(slope.alias("s"), direction.alias("a"), T.southness(direction, slope).alias("south")).first()
    assert row["s"] == pytest.approx(45)
    assert row["a"] == pytest.approx(aspect)
    assert row["south"] == pytest.approx((1 - np.cos(np.radians(aspect))) / 2)


def test_flat_cells_get_the_neutral_value(spark):
    row = spark.range(1).select(T.southness(F.lit(180.0), F.lit(0.5)).alias("s")).first()
    assert row["s"] == 0.5
    with pytest.raises(ValueError):
        T.southness(F.lit(1.0), F.lit(1.0), flat_value=1.5)


def test_cell_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        T.horn_gradients(frame(spark, np.ones((3, 3))), "z", 0)


def test_gap_fill_uses_the_layer_mean(spark):
    z = np.array([[1.0, np.nan], [3.0, 5.0]])
    assert gather(T.fill_with_mean(frame(spark, z), "z"), "z", z.shape)[0, 1] == 3.0


@pytest.mark.parametrize("size,tile", [(3, 4), (5, 4), (3, 64)])
def test_focal_mean_ignores_gaps(spark, size, tile):
    z = np.random.default_rng(1).normal(size=(11, 9))
    z[2:6, 3] = np.nan
    got = gather(T.focal_mean(frame(spark, z), "z", "f", size, tile=tile), "f", z.shape)
    h = size // 2
    for r in range(11):
        for c in range(9):
            assert got[r, c] == pytest.approx(np.nanmean(z[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]))


def test_gaps_and_pure_cells_of_several_grids(spark):
    z = np.arange(16.0).reshape(4, 4)
    z[0, 1] = np.nan
    both = frame(spark, z).withColumn("grid", F.lit("a")).unionByName(frame(spark, z * 10).withColumn("grid", F.lit(None).cast("string")))
    filled = {r["grid"]: r["z"] for r in T.fill_with_mean(both, "z", keys=["grid"]).where("row = 0 AND col = 1").collect()}
    assert filled == {"a": pytest.approx(np.nanmean(z)), None: pytest.approx(np.nanmean(z) * 10)}
    rng = np.random.default_rng(2)
    grids = {g: np.kron(rng.integers(1, 3, (4, 4)), np.ones((3, 3))) for g in ("a", "b")}
    codes = functools.reduce(lambda x, y: x.unionByName(y), [frame(spark, v).withColumn("grid", F.lit(g)) for g, v in grids.items()])
    got = {(r["grid"], r["row"], r["col"]) for r in T.pure_cells(codes, "z", 12, 12, tile=5, keys=["grid"]).collect()}
    alone = {(g, r["row"], r["col"]) for g, v in grids.items() for r in T.pure_cells(frame(spark, v), "z", 12, 12, tile=5).collect()}
    assert got == alone and got


def test_pure_cells_match_brute_force(spark):
    codes = np.array([[1] * 6 + [2] * 6] * 12)
    codes[8, 2] = 3
    got = {(r["row"], r["col"]) for r in T.pure_cells(frame(spark, codes), "z", 12, 12, tile=5).collect()}
    expected = {
        (r, c) for r in range(2, 10) for c in range(2, 10) if len(set(codes[r - 1 : r + 2, c - 1 : c + 2].ravel())) == 1
    }
    assert got == expected


def test_distance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((23, 31)) < 0.03
    mask[:, 4] = False
    mask[7, 9] = True
    df = frame(spark, mask.astype(float)).withColumn("wet", F.col("z") == 1)
    got = gather(euclidean_distance(df, "wet", 30.0), "distance_m", mask.shape)
    rows, cols = np.nonzero(mask)
    r, c = np.mgrid[0:23, 0:31]
    expected = np.sqrt(((r[..., None] - rows) ** 2 + (c[..., None] - cols) ** 2).min(axis=-1)) * 30
    np.testing.assert_array_equal(got, expected)


@pytest.mark.parametrize("shape,share", [((23, 31), 0.03), ((1, 400), 0.01), ((400, 1), 0.01), ((40, 60), 0.0), ((9, 120), 0.3)])
def test_lines_in_stretches_equal_brute_force(spark, shape, share):
    rng = np.random.default_rng(7)
    mask = rng.random(shape) < share
    mask[shape[0] // 2, shape[1] // 3] = True
    df = frame(spark, mask.astype(float)).withColumn("wet", F.col("z") == 1)
    got = gather(euclidean_distance(df, "wet", 30.0, span=8), "distance_m", shape)
    rows, cols = np.nonzero(mask)
    r, c = np.mgrid[0 : shape[0], 0 : shape[1]]
    expected = np.sqrt(((r[..., None] - rows) ** 2 + (c[..., None] - cols) ** 2).min(axis=-1)) * 30
    np.testing.assert_array_equal(got, expected)


def test_distance_of_long_rows_prices_borders_in_levels(spark, monkeypatch):
    from aridscape.operators import distance

    rng = np.random.default_rng(21)
    shape = (2, 150)
    wet = rng.random(shape) < 0.04
    wet[0, 40:110] = False
    df = spark.createDataFrame([(r * 150 + c, r, c, bool(wet[r, c])) for r in range(2) for c in range(150)], "cell_id long, row long, col long, wet boolean")
    at = np.argwhere(wet)
    levels, cut = [], distance.cut_lineage
    monkeypatch.setattr(distance, "cut_lineage", lambda d: (levels.append(1), cut(d))[1])
    monkeypatch.setattr(distance, "FAN", 3)
    got = euclidean_distance(df, "wet", 1.0, span=4).collect()
    assert len(got) == 300 and len(levels) > 2  # 38 borders, three at once
    for r in got:
        assert r["distance_m"] == pytest.approx(np.sqrt(((at - [r["row"], r["col"]]) ** 2).sum(1).min()))


def test_stretches_keep_grids_apart(spark):
    df = frame(spark, np.zeros((12, 30))).withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))))
    df = df.withColumn("wet", (F.col("g").isNull()) & (F.col("row") == 3) & (F.col("col") == 20))
    out = euclidean_distance(df, "wet", 10.0, keys=["g"], span=7)
    assert out.count() == 3 * 360
    assert out.where("g IS NOT NULL AND distance_m IS NOT NULL").count() == 0
    far = out.where("g IS NULL").agg(F.max("distance_m"), F.count("distance_m")).first()
    assert far[0] == pytest.approx(10 * np.hypot(8, 20)) and far[1] == 360


def test_ragged_lines_give_each_cell_its_distance(spark):
    df = frame(spark, np.zeros((2, 40))).where("row = 0 OR col < 5").withColumn("wet", (F.col("row") == 0) & (F.col("col") == 39))
    out = {(r["row"], r["col"]): r["distance_m"] for r in euclidean_distance(df, "wet", 1.0, span=8).collect()}
    assert len(out) == 45 and out[0, 0] == 39


def test_no_cells_give_no_distances(spark):
    df = frame(spark, np.zeros((2, 2))).withColumn("wet", F.col("z") == 1)
    assert euclidean_distance(df.where("cell_id < 0"), "wet", 1.0).count() == 0


def test_distance_is_per_grid_and_undefined_without_features(spark):
    df = frame(spark, np.zeros((4, 5))).withColumn("g", F.explode(F.array(F.lit(1), F.lit(2))))
    df = df.withColumn("wet", (F.col("g") == 1) & (F.col("cell_id") == 0))
    out = euclidean_distance(df, "wet", 10.0, keys=["g"])
    assert out.where("g = 2 AND distance_m IS NOT NULL").count() == 0
    assert out.where("g = 1").agg(F.max("distance_m")).first()[0] == pytest.approx(50.0)
    with pytest.raises(ValueError, match="empty"):
        require_features(df.where("wet AND g = 2"))


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def vectors(spark, rows):
    schema = "feature_id long, geom_type string, part int, points array<struct<x:double,y:double>>, tags map<string,string>"
    return spark.createDataFrame([(i, k, p, pts, t) for i, k, p, pts, t in rows], schema)


SPEC = GridSpec("EPSG:32635", 10.0, 12, 8, 0.0, 80.0)


def test_polygon_hole_stays_empty(spark):
    ring = vectors(spark, [(1, "polygon", 0, square(10.0, 10.0, 90.0, 70.0), {}), (1, "polygon", 1, square(30.0, 30.0, 60.0, 50.0), {})])
    got = {(r["row"], r["col"]) for r in filled_cells(segments(ring, ["feature_id"]), SPEC, ["feature_id"]).collect()}
    expected = {(r, c) for r in range(1, 7) for c in range(1, 9) if not (3 <= r < 5 and 3 <= c < 6)}
    assert got == expected


def test_touched_cells_against_dense_sampling(spark):
    rng = np.random.default_rng(2)
    pts = [tuple(p) for p in rng.uniform((-20, -20), (140, 100), (12, 2))]
    got = {(r["row"], r["col"]) for r in rasterize(vectors(spark, [(1, "line", 0, [(float(a), float(b)) for a, b in pts], {})]), SPEC).collect()}
    seen = set()
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        t = np.linspace(0, 1, 40001)
        x, y = ax + (bx - ax) * t, ay + (by - ay) * t
        keep = (x >= 0) & (x < 120) & (y > 0) & (y <= 80)
        seen |= set(zip(np.floor((80 - y[keep]) / 10).astype(int), np.floor(x[keep] / 10).astype(int)))
    assert seen <= got and len(got - seen) <= 1


def test_no_geometry_is_an_error(spark):
    with pytest.raises(ValueError):
        rasterize(vectors(spark, []), SPEC)


def test_decimate_and_blocks(spark):
    df = frame(spark, np.zeros((9, 10)))
    assert decimate(df, 3).count() == 3 * 4
    assert df.select(block_id(5, 2).alias("b")).distinct().count() == 4


def test_level_edge_touches_its_own_row_only(spark):
    got = rasterize(vectors(spark, [(1, "line", 0, [(SPEC.left + 0.5 * SPEC.resolution, SPEC.top - 1.5 * SPEC.resolution), (SPEC.left + 2.5 * SPEC.resolution, SPEC.top - 1.5 * SPEC.resolution)], {})]), SPEC)
    assert {(r["row"], r["col"]) for r in got.collect()} == {(1, 0), (1, 1), (1, 2)}
