import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import classify as K
from aridscape.operators import composites as C
from aridscape.operators import normalize as N
from aridscape.operators import overlay as O
from aridscape.plans.risk_map import build_risk_map, criterion_weights, weight_sensitivity
from aridscape.sources.config import ConfigError, landcover_table, load_config, matrix_rows
from aridscape.sources.grid import GridSpec


def layer(spark, values):
    rows = [(i, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell_id long, v double")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("cell_id").collect()]


# --- composites -------------------------------------------------------------------


def test_indices_on_known_surfaces(spark):
    rows = spark.createDataFrame([(0.22, 0.22, 0.07), (0.08, 0.56, 0.04), (0.0, 0.0, 0.0), (-0.35, 0.28, 0.0)], "r double, n double, b double")
    got = rows.select(C.ndvi(F.col("r"), F.col("n")).alias("ndvi"), C.evi(F.col("r"), F.col("n"), F.col("b")).alias("evi")).collect()
    assert got[0]["ndvi"] == 0.0
    assert got[1]["ndvi"] == pytest.approx(0.75)
    assert got[2]["ndvi"] is None
    assert got[3]["ndvi"] is None
    assert got[1]["evi"] == pytest.approx(2.5 * 0.48 / (0.56 + 6 * 0.08 - 7.5 * 0.04 + 1))
    with pytest.raises(ValueError):
        C.vegetation_index("savi", F.col("r"), F.col("n"))


def test_offset_depends_on_the_baseline(spark):
    texts = spark.createDataFrame([("02.12",), ("04.00",), ("05.11",), ("nan",), ("x",), (None,)], "b string")
    assert [r[0] for r in texts.select(C.baseline_offset(F.col("b"))).collect()] == [0.0, -1000.0, -1000.0, 0.0, 0.0, 0.0]


def test_fill_is_masked_before_scaling(spark):
    got = spark.createDataFrame([(0.0,), (10000.0,)], "v double").select(C.scaled(F.col("v"), F.lit(2.75e-5), F.lit(-0.2), F.lit(0.0))).collect()
    assert got[0][0] is None and got[1][0] == pytest.approx(0.075)


def test_quality_bits(spark):
    qa = [0, 1, 2, 4, 8, 16, 32, 64]
    got = spark.createDataFrame([(q,) for q in qa], "q int").select(C.qa_clear(F.col("q"))).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, False, False, True]


def test_same_day_mosaic_takes_the_first_defined(spark):
    obs = spark.createDataFrame(
        [(1, "2024-07-01", 1, None, 5.0), (1, "2024-07-01", 2, 3.0, 6.0), (1, "2024-07-02", 3, 9.0, None)],
        "cell_id int, day string, scene_id int, red double, nir double",
    )
    got = {r["day"]: (r["red"], r["nir"]) for r in C.same_day_mosaic(obs, ["red", "nir"]).collect()}
    assert got == {"2024-07-01": (3.0, 5.0), "2024-07-02": (9.0, None)}


def test_rain_normal_is_strict_per_year(spark):
    rows = [(1, y, m, 10.0) for y in (2000, 2001) for m in (7, 8, 9)]
    rows[-1] = (1, 2001, 9, -9999.0)
    df = spark.createDataFrame(rows, "cell_id int, year int, month int, v double")
    assert C.seasonal_rain_normal(df, "v", [7, 8, 9]).first()["precip"] == 30.0


def test_water_capacity_skips_bad_depths(spark):
    rows = [(1, 300.0, 100.0, 5.0), (1, 100.0, 200.0, 10.0), (1, 400.0, 100.0, 15.0), (2, 0.0, 50.0, 5.0)]
    got = values(C.water_capacity(spark.createDataFrame(rows, "cell_id int, field_capacity double, wilting_point double, thickness double")), "awc")
    assert got[0] == pytest.approx((0.2 * 5 + 0.3 * 15) / 20) and got[1] is None


def test_month_ranges(spark):
    assert C.month_range(7, 9) == [7, 8, 9]
    for bad in ((0, 3), (11, 2)):
        with pytest.raises(ValueError):
            C.month_range(*bad)
    first, last = C.month_bounds(F.lit(2024), F.lit(2))
    assert str(spark.range(1).select(last).first()[0]) == "2024-02-29"


# --- normalisation ----------------------------------------------------------------


def test_percentile_scaling_resists_an_outlier(spark):
    data = np.append(np.random.default_rng(8).random(700), [-4e5, 2.5e6])
    out = values(N.score_layers(layer(spark, data), [N.Criterion("v", "minmax_percentile", True)]))
    lo, hi = np.percentile(data, [2, 98])
    np.testing.assert_allclose(out, np.clip((data - lo) / (hi - lo), 0, 1), atol=1e-12)


def test_direction_flip_and_null_propagation(spark):
    out = values(N.score_layers(layer(spark, [0.0, 5.0, 10.0, None]), [N.Criterion("v", "minmax_capped", False, cap=10.0)]))
    assert out == [1.0, 0.5, 0.0, None]


def test_log_transform_takes_percentiles_after_the_log(spark):
    data = np.exp(np.random.default_rng(11).gamma(4.0, 0.9, 640) + 3)
    out = values(N.score_layers(layer(spark, data), [N.Criterion("v", "minmax_percentile", True, log_transform=True)]))
    logged = np.log1p(data)
    lo, hi = np.percentile(logged, [2, 98])
    np.testing.assert_allclose(out, np.clip((logged - lo) / (hi - lo), 0, 1), atol=1e-12)


@pytest.mark.parametrize(
    "data,spec",
    [
        ([42.0] * 10, N.Criterion("v", "minmax_percentile", True)),
        ([None, None], N.Criterion("v", "none", True)),
        ([0.2, 1.4], N.Criterion("v", "lookup", True)),
        ([-1.0, 3.0, 4.0], N.Criterion("v", "minmax_percentile", True, log_transform=True)),
    ],
)
def test_unusable_layers_are_rejected(spark, data, spec):
    with pytest.raises(N.NormalizationError):
        N.score_layers(layer(spark, data), [spec])


def test_criterion_configuration_guards():
    with pytest.raises(N.NormalizationError):
        N.Criterion("v", "zscore", True)
    with pytest.raises(N.NormalizationError):
        N.Criterion("v", "minmax_capped", True)
    with pytest.raises(N.NormalizationError):
        N.Criterion("v", "minmax_percentile", True, percentiles=(98, 2))


def test_lookup_scores(spark):
    codes = spark.createDataFrame([(0, 40), (1, 10), (2, 80)], "cell_id int, code int")
    assert values(N.lookup_scores(codes, landcover_table(spark)), "score") == [0.9, 0.25, None]
    with pytest.raises(ValueError, match="without an entry"):
        N.lookup_scores(codes.union(spark.createDataFrame([(3, 77)], "cell_id int, code int")), landcover_table(spark))
    with pytest.raises(ValueError, match="masked"):
        N.lookup_scores(codes.where("code = 80"), landcover_table(spark))


def test_unregistered_criterion(spark):
    with pytest.raises(KeyError, match="no raw builder"):
        N.build_criteria(layer(spark, [1.0]), [N.Criterion("nope", "none", True)])


# --- classes ------------------------------------------------------------------------


def test_breaks_are_right_closed(spark):
    df = layer(spark, [0.0, 0.2, 0.2000001, 0.9, None])
    assert values(df.select("cell_id", K.apply_breaks(F.col("v"), [0.2, 0.5, 0.8]).alias("v"))) == [1, 1, 2, 3, 0]
    with pytest.raises(ValueError):
        K.apply_breaks(F.col("v"), [0.1, 0.2], 5)


def brute_jenks(data, k):
    data = np.sort(data)
    n = len(data)
    sse = lambda a, b: ((data[a:b] - data[a:b].mean()) ** 2).sum()
    best = {(1, e): (sse(0, e), [e]) for e in range(1, n + 1)}
    for g in range(2, k + 1):
        for e in range(g, n + 1):
            best[(g, e)] = min(((best[(g - 1, s)][0] + sse(s, e), best[(g - 1, s)][1] + [e]) for s in range(g - 1, e)), key=lambda t: t[0])
    return best[(k, n)][0]


def within_sse(data, breaks):
    classes = np.searchsorted(breaks[:-1], data, side="left")
    return sum(((data[classes == c] - data[classes == c].mean()) ** 2).sum() for c in range(len(breaks)) if (classes == c).any())


def test_natural_breaks_are_optimal_on_few_values(spark):
    data = np.round(np.random.default_rng(4).beta(2, 5, 60), 4)
    breaks = K.compute_breaks(layer(spark, data), "v", n_classes=4)
    assert breaks[-1] == data.max()
    assert within_sse(data, np.array(breaks)) == pytest.approx(brute_jenks(data, 4), rel=1e-9)


def test_natural_breaks_do_not_depend_on_the_bars(spark):
    data = np.random.default_rng(4).beta(2, 5, 4000)
    coarse = K.compute_breaks(layer(spark, data), "v", n_classes=5, bars=64)
    fine = K.compute_breaks(layer(spark, data), "v", n_classes=5)
    assert within_sse(data, np.array(coarse)) <= within_sse(data, np.array(fine)) * 1.001
    assert set(coarse) <= set(data)
    agreement = K.kmeans_agreement(layer(spark, data), "v", fine).first()
    assert agreement["n"] == 4000 and agreement["agreement"] > 0.97


def test_natural_breaks_of_a_stretched_range(spark):
    data = np.concatenate([np.random.default_rng(5).random(3000) * 1e-3, [7.0, 80.0, 300.0, 650.0, 990.0]])
    breaks = K.compute_breaks(layer(spark, data), "v", n_classes=5)
    assert breaks == [7.0, 80.0, 300.0, 650.0, 990.0]


def test_other_breaks_and_guards(spark):
    df = layer(spark, np.linspace(0, 1, 101))
    assert K.compute_breaks(df, "v", method="equal_interval") == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    assert K.compute_breaks(df, "v", method="quantile") == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    with pytest.raises(ValueError):
        K.compute_breaks(df, "v", method="stddev")
    with pytest.raises(ValueError):
        K.compute_breaks(df, "v", n_classes=1)
    with pytest.raises(ValueError, match="distinct"):
        K.compute_breaks(layer(spark, [1.0, 2.0, 2.0]), "v", n_classes=3)
    with pytest.raises(ValueError, match="no defined"):
        K.compute_breaks(layer(spark, [None]), "v")


# --- overlay ------------------------------------------------------------------------


def stack(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"cell_id": range(n), "a": rng.random(n), "b": rng.random(n), "c": rng.random(n)})
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("c", F.when(F.col("cell_id") != 3, F.col("c")))


def test_overlay_masks_and_checks_weights(spark):
    pdf, df = stack(spark)
    out = O.weighted_overlay(df, {"a": 0.5, "b": 0.3, "c": 0.2}).orderBy("cell_id").collect()
    assert out[3]["risk"] is None
    assert out[5]["risk"] == pytest.approx(0.5 * pdf.a[5] + 0.3 * pdf.b[5] + 0.2 * pdf.c[5])
    for bad in ({"a": 0.5, "b": 0.3, "c": 0.3}, {"a": 1.2, "b": -0.2, "c": 0.0}):
        with pytest.raises(ValueError):
            O.weighted_overlay(df, bad)
    with pytest.raises(ValueError):
        O.weighted_overlay(df, {"a": 1.0}, names=["a", "b"])


def test_mitigation_lowers_risk_near_water(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 1.0)], "cell_id int, a double, distance_to_water double")
    w = {"a": 0.5, "distance_to_water": 0.5}
    assert values(O.weighted_overlay(df, w), "risk") == pytest.approx([0.5 * 0.7, 1.0])
    assert values(O.weighted_overlay(df, w, mitigation=0.0), "risk") == pytest.approx([0.5, 1.0])


def test_stack_requires_every_layer(spark):
    tall = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (2, "a", 0.2)], "cell_id int, layer string, value double")
    rows = {r["cell_id"]: (r["a"], r["b"]) for r in O.stack_layers(tall, ["a", "b"]).collect()}
    assert rows == {1: (0.5, 0.1), 2: (0.2, None)}
    with pytest.raises(FileNotFoundError):
        O.stack_layers(tall, ["a", "z"])


def test_contributions_sum_to_one(spark):
    _, df = stack(spark)
    rows = O.contributions(df, {"a": 0.6, "b": 0.3, "c": 0.1}).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1)
    assert max(rows, key=lambda r: r["share"])["criterion"] == "a"


def test_dropping_keeps_ratios():
    out = O.dropped_weights({"a": 0.5, "b": 0.3, "c": 0.2}, ["a"])
    assert out == {"a": 0.0, "b": pytest.approx(0.6), "c": pytest.approx(0.4)}
    with pytest.raises(ValueError):
        O.dropped_weights({"a": 1.0}, ["a"])
    with pytest.raises(ValueError):
        O.dropped_weights({"a": 1.0}, ["q"])


CONFIG = {
    "grid": {}, "aoi": {"bbox_wgs84": [27, 38, 28, 39]}, "paths": {},
    "criteria": {
        "a": {"normalization": "minmax_percentile", "higher_is_riskier": True},
        "b": {"normalization": "minmax_percentile", "higher_is_riskier": True},
        "c": {"normalization": "none", "higher_is_riskier": True},
    },
    "scenarios": {"active": "up", "definitions": {"up": {"criteria_overrides": {"b": {"higher_is_riskier": True}}}, "down": {"criteria_overrides": {"b": {"higher_is_riskier": False}}}}},
    "ahp": {"criteria_order": ["a", "b", "c"], "matrix": [[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]]},
    "classification": {"n_classes": 2, "labels": {1: "l", 2: "h"}, "colors": ["x", "y"]},
}


def test_config_scenarios_and_guards():
    up, down = load_config(CONFIG), load_config(CONFIG, "down")
    assert up.criterion("b").higher_is_riskier and not down.criterion("b").higher_is_riskier
    assert (down.storage_scenario("b"), down.storage_scenario("a")) == ("down", "shared")
    assert CONFIG["criteria"]["b"]["higher_is_riskier"] is True
    with pytest.raises(ConfigError):
        load_config(CONFIG, "sideways")
    with pytest.raises(ConfigError):
        load_config({**CONFIG, "aoi": {"bbox_wgs84": [28, 38, 27, 39]}})
    with pytest.raises(ConfigError):
        load_config({k: v for k, v in CONFIG.items() if k != "paths"})
    with pytest.raises(ConfigError):
        load_config({**CONFIG, "ahp": {"criteria_order": ["a", "b"], "matrix": [[1, 2], [0.5, 1]]}})
    with pytest.raises(ConfigError):
        up.criterion("zzz")


def test_risk_map_end_to_end(spark):
    _, df = stack(spark, 1200)
    config = load_config(CONFIG)
    weights = criterion_weights(matrix_rows(spark, config), config.criteria_order)
    assert list(weights.values()) == pytest.approx([4 / 7, 2 / 7, 1 / 7])
    result = build_risk_map(df, config.criteria(), weights, GridSpec("EPSG:32635", 30, 40, 30, 0, 0))
    assert result.breaks == sorted(result.breaks)
    rows = {r["class"]: r for r in result.classes.collect()}
    assert rows[None]["cells"] == 1199 and rows[0]["cells"] == 1
    assert sum(rows[k]["share_pct"] for k in range(1, 6)) == pytest.approx(100)
    shifted = {r["scenario"]: r for r in weight_sensitivity(result).collect()}
    assert len(shifted) == 6
    assert all(0.7 < r["class_agreement"] <= 1 and r["spearman_rho"] > 0.95 for r in shifted.values())
    other = build_risk_map(df, load_config(CONFIG, "down").criteria(), weights, GridSpec("EPSG:32635", 30, 40, 30, 0, 0))
    pair = result.cells.select("cell_id", F.col("risk").alias("ra"), F.col("class").alias("ca")).join(
        other.cells.select("cell_id", F.col("risk").alias("rb"), F.col("class").alias("cb")), "cell_id"
    )
    assert O.agreement(pair, "ra", "rb", "ca", "cb").first()["mean_abs_diff"] > 1e-4
