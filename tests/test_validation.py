import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import anomaly as M
from aridscape.operators import ml as L
from aridscape.operators import validate as V
from aridscape.plans.historical_test import criterion_drop_test, dry_labels, historical_test, long_record_anomalies
from aridscape.plans.layer_swap import compare_layers
from aridscape.sources.config import landcover_table


def impact(spark, matrix, first=2000):
    rows = [(c, first + y, None if np.isnan(v) else float(v)) for c, cell in enumerate(matrix) for y, v in enumerate(cell)]
    return spark.createDataFrame(rows, "cell_id long, year int, value double")


# --- anomalies ------------------------------------------------------------------


def test_leave_one_out_equals_numpy(spark):
    rng = np.random.default_rng(0)
    m = 1e6 + rng.normal(size=(40, 8))
    m[3, 2] = np.nan
    m[5] = 7.0
    for standardize in (False, True):
        got = M.leave_one_out(impact(spark, m), standardize=standardize).toPandas().pivot(index="cell_id", columns="year", values="anomaly").to_numpy()
        for y in range(8):
            rest = np.delete(m, y, axis=1)
            diff = m[:, y] - np.nanmean(rest, axis=1)
            std = np.nanstd(rest, axis=1, ddof=1)
            expected = np.where(std > 0.01, diff / np.where(std > 0, std, 1), np.nan) if standardize else diff
            np.testing.assert_allclose(got[:, y], expected, atol=1e-6)


def test_leaving_the_year_out_shows_the_full_drop(spark):
    row = M.leave_one_out(impact(spark, [[0.61, 0.64, 0.58, 0.63, 0.59, 0.36]]), standardize=False).where("year = 2005").first()
    assert row["anomaly"] == pytest.approx(0.36 - 3.05 / 5)


def test_report_shares_and_classes(spark):
    out = M.leave_one_out(impact(spark, [[0.5] * 6, [0.1, 0.5, 0.2, 0.6, 0.3, 0.9]]))
    report = M.mask_report(out).first()
    assert report["masked_share"] == 0.5 and report["unstable_share"] == 0.5
    shares = M.class_shares(out).groupBy("year").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)


def test_baseline_length_and_source_guards(spark):
    layers = impact(spark, [[0.1] * 5])
    with pytest.raises(ValueError, match="baseline has 4"):
        M.require_years(layers, 5)
    with pytest.raises(KeyError):
        M.signed(layers, "radar")
    hot = long_record_anomalies(impact(spark, [list(range(12))]), "lst", min_baseline=10)
    assert hot.where("year = 2011").first()["anomaly"] < 0


def test_monotone_check(spark):
    means = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.2), (1, 3, 0.2), (2, 1, 0.1), (2, 2, 0.4), (2, 3, 0.0)], "k int, class int, mean double")
    got = {r["k"]: (r["monotone"], r["extremes_ordered"]) for r in M.monotone_check(means, keys=["k"]).collect()}
    assert got == {1: (True, True), 2: (False, True)}


# --- labels and verdicts -----------------------------------------------------------


def labels_series(spark):
    rows = []
    for y in range(2017, 2026):
        for m in range(1, 13):
            soil = 40.0 if y in (2019, 2022) and m in (3, 4) else 80.0 + y % 3
            rain = 5.0 if (y, m) in {(2017, 11), (2017, 12), (2018, 1), (2018, 2), (2018, 3), (2018, 4)} else 60.0 + m % 2
            rows.append((1, dt.date(y, m, 1), soil, rain))
    return spark.createDataFrame(rows, "region_id int, month date, soil double, ppt double")


def test_dry_year_labels(spark):
    df = labels_series(spark)
    dry = lambda out: sorted(r["year"] for r in out.where("is_dry").collect())
    assert dry(V.label_dry_years(df, "soil")) == [2019, 2022]
    # the edge years hold half a wet season and count as dry too
    assert 2018 in dry(V.label_dry_years(df, "ppt", method="wet_season_precip"))
    assert dry(V.label_dry_years(df.withColumn("spi", F.when(F.year("month") == 2020, -1.0).otherwise(0.2)), "spi", method="summer_spi")) == [2020]
    with pytest.raises(ValueError):
        V.label_dry_years(df, "soil", method="moon")


@pytest.mark.parametrize(
    "n_dry,n_other,dry,other,need,expected",
    [
        (1, 5, -0.5, 0.1, False, "undecided"),
        (3, 5, -0.04, 0.2, False, "not_supported"),
        (3, 5, -0.10, 0.2, False, "not_supported"),
        (3, 5, -0.30, -0.25, False, "not_supported"),
        (3, 5, -0.30, 0.05, False, "supported"),
        (3, 0, -0.30, None, True, "undecided"),
        (3, 5, None, 0.05, False, "undecided"),
    ],
)
def test_verdicts(spark, n_dry, n_other, dry, other, need, expected):
    df = spark.createDataFrame([(n_dry, n_other, dry, other)], "n_dry long, n_other long, dry_rho double, other_rho double")
    assert V.verdict(df, need_other=need).first()["verdict"] == expected


def test_pooling_weights_by_cells(spark):
    means = spark.createDataFrame([(2011, 2, 3.0, 25), (2012, 2, -0.5, 175), (2013, 2, 9.0, 40)], "year int, class int, mean double, n long")
    labels = spark.createDataFrame([(2011, True), (2012, True), (2013, False)], "year int, is_dry boolean")
    assert V.pooled_class_means(means, labels).first()["mean"] == pytest.approx((75 - 87.5) / 200)
    assert V.pooled_class_means(means, labels, dry_only=False).first()["n"] == 240


def test_labels_of_two_regions_stay_apart(spark):
    rows = [(g, y, c, c / 10, 1 + c // 50, (0.1 if g == "n" else -0.1) * c) for g in "ns" for y in (2011, 2012, 2013) for c in range(100)]
    joined = spark.createDataFrame(rows, "region_id string, year int, cell int, risk double, class int, anomaly double")
    labels = spark.createDataFrame([(g, y, 0.0, (g == "n") == (y == 2012)) for g in "ns" for y in (2011, 2012, 2013)], "region_id string, year int, severity double, is_dry boolean")
    got = V.yearly_test(joined, labels, label_keys=["region_id"]).collect()
    assert len(got) == 6 and all(r["is_dry"] == ((r["region_id"] == "n") == (r["year"] == 2012)) for r in got)
    assert all(r["rho"] == pytest.approx(1 if r["region_id"] == "n" else -1) for r in got)
    means = joined.groupBy("region_id", "year", "class").agg(F.avg("anomaly").alias("mean"), F.count("*").alias("n"))
    pooled = V.pooled_class_means(means, labels, label_keys=["region_id"]).collect()
    assert {(r["region_id"], r["class"]): r["n"] for r in pooled} == {("n", 1): 50, ("n", 2): 50, ("s", 1): 100, ("s", 2): 100}
    with pytest.raises(Exception, match="several labels"):
        V.yearly_test(joined, labels).collect()


@pytest.fixture(scope="module")
def world(spark):
    """Impact that follows the risk only in dry years."""
    rng = np.random.default_rng(1)
    n, years = 500, list(range(1990, 2004))
    a, b = rng.random(n), rng.random(n)
    dry = {1993, 1997, 1999, 2002}
    m = np.array([[0.5 - (0.3 * a[c] if y in dry else 0) + rng.normal(0, 0.02) for y in years] for c in range(n)])
    stack = spark.createDataFrame(pd.DataFrame({"cell_id": range(n), "a": a, "b": b, "row": np.arange(n) // 25, "col": np.arange(n) % 25}))
    severity = spark.createDataFrame([(y, -1.5 if y in dry else 0.4) for y in years], "year int, severity double")
    return stack.cache(), impact(spark, m, 1990).cache(), severity


def test_historical_test_supports_a_planted_effect(world):
    stack, layers, severity = world
    labels = dry_labels(severity)
    anomalies = long_record_anomalies(layers, "ndvi")
    risk = stack.select("cell_id", F.col("a").alias("risk"), (F.floor(F.col("a") * 5) + 1).cast("int").alias("class"))
    out = historical_test(anomalies, risk, labels)
    verdict = out["verdict"].first()
    assert verdict["verdict"] == "supported" and verdict["n_dry"] == 4
    pooled = {r["class"]: r["mean"] for r in out["pooled_dry"].collect()}
    assert pooled[5] < pooled[1] - 0.1
    assert out["yearly"].where("is_dry AND monotone").count() == 4


def test_dropping_the_noise_criterion_is_supported(world):
    stack, layers, severity = world
    anomalies = long_record_anomalies(layers, "ndvi")
    out = criterion_drop_test(stack, {"a": 0.3, "b": 0.7}, ["b"], anomalies, dry_labels(severity)).first()
    assert out["reduced_rho"] < out["full_rho"] and out["verdict"] == "supported"
    worse = criterion_drop_test(stack, {"a": 0.5, "b": 0.5}, ["a"], anomalies, dry_labels(severity)).first()
    assert worse["verdict"] == "rejected_weaker"


def test_decoupling_trend(spark):
    years, rho = [1988, 1993, 1999, 2004, 2010], [-0.4, -0.33, -0.31, -0.2, -0.17]
    df = spark.createDataFrame([(y, True, r) for y, r in zip(years, rho)] + [(2011, False, 0.9)], "year int, is_dry boolean, rho double")
    out = V.decoupling_trend(df).first()
    slope, intercept = np.polyfit(years, rho, 1)
    assert out["slope"] == pytest.approx(slope) and out["intercept"] == pytest.approx(intercept)
    r = np.corrcoef(years, rho)[0, 1]
    t = abs(r) * np.sqrt(3 / (1 - r * r))
    # tail of Student's t with 3 degrees of freedom, integrated numerically
    x = np.linspace(t, 4000, 4_000_001)
    tail = np.trapezoid(2 / (np.pi * np.sqrt(3) * (1 + x * x / 3) ** 2), x)
    assert out["p_value"] == pytest.approx(2 * tail, rel=1e-3) and out["significant"]
    assert V.decoupling_trend(df.where("year < 1995")).isEmpty()


def test_zones_and_bands(spark):
    rng = np.random.default_rng(2)
    n = 3000
    df = spark.createDataFrame(pd.DataFrame({"code": rng.choice([10, 40, 80], n), "z": np.round(rng.normal(500, 100, n), 3), "risk": rng.random(n)}))
    pdf = df.toPandas()
    bands = V.risk_by_elevation(df, "z").orderBy("band").collect()
    edges = np.percentile(pdf["z"], [0, 20, 40, 60, 80, 100])
    assert sum(b["n"] for b in bands) == n
    for i, b in enumerate(bands):
        upper = pdf["z"] <= edges[5] if i == 4 else pdf["z"] < edges[i + 1]
        part = pdf[(pdf["z"] >= edges[i]) & upper]
        assert b["n"] == len(part) and b["mean_risk"] == pytest.approx(part["risk"].mean())
    cover = V.risk_by_landcover(df, landcover_table(spark), min_cells=500).collect()
    assert {r["code"] for r in cover} == {10, 40}
    assert V.risk_by_landcover(df, landcover_table(spark), min_cells=10**6).isEmpty()


def test_quality_checks_catch_bad_layers(spark):
    rng = np.random.default_rng(0)
    a = rng.random(500)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a * 0.999, "flat": 0.5, "risk": a, "class": (a * 5).astype(int) + 1, "raw": 1 - a}))
    got = {r["check"]: r["passed"] for r in V.quality_checks(df, ["a", "b", "flat"], directions={"raw": "a", "a": "a"}).collect()}
    assert not got["duplicate:a:b"] and not got["constant:flat"] and not got["direction:a"]
    assert got["unit_range:a"] and got["coverage"] and got["direction:raw"] and all(got[f"class_share:{k}"] for k in range(1, 6))


def test_layer_comparison_picks_the_closer_one(spark):
    rng = np.random.default_rng(0)
    truth = rng.normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"x": truth + rng.normal(size=800), "y": truth + 0.1 * rng.normal(size=800), "ref": -truth}))
    row = compare_layers(df, "x", "y", "ref", names=("ndvi", "evi")).first()
    assert row["better"] == "evi" and row["rho_evi"] < row["rho_ndvi"] < 0


# --- machine learning ----------------------------------------------------------------


@pytest.fixture(scope="module")
def training(world):
    stack, layers, severity = world
    anomalies = long_record_anomalies(layers, "ndvi")
    return L.training_table(stack, anomalies, severity, ["a", "b"], valid=["a", "b"]).cache()


def test_training_rows_come_from_dry_years(training):
    assert sorted(r["year"] for r in training.select("year").distinct().collect()) == [1993, 1997, 1999, 2002]
    assert L.equal_sample(training, 400).groupBy("year").count().where("count <> 100").isEmpty()
    assert L.feature_names(["lst", "ndvi_dry", "slope", "water"]) == ["lst", "slope"]
    assert L.feature_names(["lst", "ndvi_dry"], "full") == ["lst"]


def test_folds_keep_blocks_whole_and_balanced(training):
    folded = L.assign_folds(training.withColumn("block", F.expr("(row div 5) * 5 + (col div 5)"))).cache()
    assert folded.groupBy("block").agg(F.countDistinct("fold").alias("f")).where("f > 1").isEmpty()
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 100
    with pytest.raises(ValueError):
        L.assign_folds(training.withColumn("block", F.lit(1)))


def test_dealing_by_size_equals_the_greedy_loop():
    rng = np.random.default_rng(4)
    for _ in range(300):
        folds = int(rng.integers(2, 7))
        sizes = sorted(rng.integers(1, rng.choice([3, 12, 60]), int(rng.integers(folds, 60))).tolist(), reverse=True)
        loads, expected = [0] * folds, []
        for n in sizes:
            f = loads.index(min(loads))
            expected.append(f)
            loads[f] += n
        got, dealt = [], [0] * folds
        for size in sorted(set(sizes), reverse=True):
            count = sizes.count(size)
            phases, dealt = L.deal_phases(dealt, size, count)
            for rank in range(count):
                start, turn = [p for p in phases if p[0] <= rank][-1]
                got.append(turn[(rank - start) % len(turn)])
        assert (got, dealt) == (expected, loads)


def test_fold_map_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(6)
    sizes = {b: int(n) for b, n in enumerate(rng.choice([1, 2, 2, 2, 7, 30], 90))}
    rows = spark.createDataFrame([(b, i) for b, n in sizes.items() for i in range(n)], "block long, x int")
    loads, expected = [0] * 4, {}
    for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
        expected[b] = loads.index(min(loads))
        loads[expected[b]] += sizes[b]
    assert {r["block"]: r["fold"] for r in L.fold_map(rows, folds=4).collect()} == expected
    assert max(loads) - min(loads) <= max(sizes.values())


def test_forest_learns_the_planted_feature(training, tmp_path):
    features = ["a", "b", L.DYNAMIC_FEATURE]
    folded = L.assign_folds(training.withColumn("block", F.expr("(row div 5) * 5 + (col div 5)")))
    scores, ranking = L.cross_validate(folded, features, path=str(tmp_path / "cv"), trees=10, depth=6)
    assert len(L.stored_model(str(tmp_path / "cv"), 5).trees) == 10
    assert scores.agg(F.min("r2")).first()[0] > 0.6
    assert ranking.first()["feature"] == "a"
    spread = L.score_spread(scores).first()
    assert spread["std_r2"] >= 0 and spread["mean_rmse"] > 0
    model = L.fit_final(training, features, path=str(tmp_path / "model"), trees=10, depth=6)
    loaded = L.stored_model(str(tmp_path / "model"))
    assert loaded.uid == model.uid
    gap = L.resilience_gap(loaded, training, features)
    assert gap.count() == 500 and abs(gap.agg(F.avg("resilience_gap")).first()[0]) < 0.01


def test_sample_bounds_the_fit_alone(training, monkeypatch):
    fitted, fit = [], L.RandomForestRegressor.fit
    monkeypatch.setattr(L.RandomForestRegressor, "fit", lambda self, df: (fitted.append(df.count()), fit(self, df))[1])
    folded = L.assign_folds(training.withColumn("block", F.expr("(row div 5) * 5 + (col div 5)"))).cache()
    scores, _ = L.cross_validate(folded, ["a", "b", L.DYNAMIC_FEATURE], sample=200, trees=2, depth=3)
    assert fitted == [200] * 5
    held_out = {r["fold"] + 1: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert {r["fold"]: r["n"] for r in scores.collect()} == held_out and sum(held_out.values()) == training.count()


def test_folds_are_fitted_side_by_side_on_few_tasks(training, monkeypatch):
    import threading

    all_at_once, tasks, fit = threading.Barrier(5, timeout=90), [], L.RandomForestRegressor.fit

    def waiting(self, df):
        all_at_once.wait()
        tasks.append(df.rdd.getNumPartitions())
        return fit(self, df)

    monkeypatch.setattr(L.RandomForestRegressor, "fit", waiting)
    folded = L.assign_folds(training.withColumn("block", F.expr("(row div 5) * 5 + (col div 5)")))
    scores, _ = L.cross_validate(folded, ["a", "b", L.DYNAMIC_FEATURE], sample=200, trees=2, depth=3)
    assert scores.count() == 5 and tasks == [L.FOLD_TASKS] * 5


def test_final_fit_reads_a_kept_sample(training, monkeypatch):
    plans, fit = [], L.RandomForestRegressor.fit
    monkeypatch.setattr(L.RandomForestRegressor, "fit", lambda self, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), fit(self, df))[1])
    L.fit_final(L.equal_sample(training, 200), ["a", "b"], trees=2, depth=3)
    assert "Join" not in plans[0] and "LogicalRDD" in plans[0]


def test_registered_forests_score_all_rows(spark, monkeypatch):
    import os

    from registry import QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("test tables are not here")
    sizes, forest, sample = [], L.forest, L.equal_sample
    monkeypatch.setattr(L, "forest", lambda f, *, trees=100, depth=15, **o: (sizes.append((trees, depth)), forest(f, trees=2, depth=2))[1])
    monkeypatch.setattr(L, "equal_sample", lambda table, *a, **o: sample(table, 100))
    rows = QUERIES["l01_training_table"](spark, data).count()
    assert rows > 200
    assert QUERIES["l03_spatial_folds"](spark, data).agg(F.sum("rows")).first()[0] == rows
    assert QUERIES["l06_final_fit"](spark, data).first()["rows"] == rows
    assert sizes == [(100, 15)]


def test_stored_forest_beats_the_mean_beyond_the_sample_size(spark, monkeypatch):
    import os

    from registry import QUERIES

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("test tables are not here")
    forest, sample, share = L.forest, L.equal_sample, getattr(L, "tree_share", None)
    monkeypatch.setattr(L, "forest", lambda f, **o: forest(f, trees=30, depth=8))
    monkeypatch.setattr(L, "equal_sample", lambda table, *a, **o: sample(table, 150))
    monkeypatch.setattr(L, "tree_share", lambda rows, trees: share(rows, trees, 150), raising=False)
    row = QUERIES["l06_stored_model"](spark, data).first()
    assert row["beats_mean"] and row["in_range"]


def test_share_of_a_tree():
    assert L.tree_share(100_000, 100) == 1.0 and L.tree_share(0, 100) == 1.0
    assert L.tree_share(1_000_000, 100) == 0.1 and L.tree_share(100_000_000, 100) == 0.03


def test_years_weigh_as_in_an_equal_sample(training):
    weights = {r["year"]: (r["n"], r["w"]) for r in L.year_weights(training, 300).groupBy("year").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    limit = 300 // len(weights)
    assert {y: n for y, (n, _) in weights.items()} == {r["year"]: r["count"] for r in training.groupBy("year").count().collect()}
    assert all(w == pytest.approx(min(n, limit)) for n, w in weights.values())


def test_residual_attribution(spark):
    rng = np.random.default_rng(3)
    n = 2000
    d, e = rng.random(n), rng.random(n)
    y = -0.8 * d + 0.1 * e + rng.normal(0, 0.2, n)
    pdf = pd.DataFrame({"y": y, "d": d, "e": e, "k": 1.0})
    df = spark.createDataFrame(pdf)
    rho = {r["factor"]: r["rho"] for r in L.factor_correlations(df, "y", ["d", "e"]).collect()}
    assert rho["d"] == pytest.approx(pdf["y"].rank().corr(pdf["d"].rank()), abs=1e-9)
    quart = {r["quartile"]: r for r in L.quartile_profile(df, "y", "d").collect()}
    groups = pdf.groupby(pd.qcut(pdf["d"], 4, labels=[1, 2, 3, 4]), observed=False)["y"]
    for q, part in groups:
        assert quart[q]["n"] == len(part) and quart[q]["median"] == pytest.approx(part.median())
        assert quart[q]["ci_95"] == pytest.approx(1.96 * part.std() / np.sqrt(len(part)))
    out = {r["factor"]: r for r in L.standardized_ols(df, "y", ["d", "e", "k"]).collect()}
    z = (pdf[["y", "d", "e"]] - pdf[["y", "d", "e"]].mean()) / pdf[["y", "d", "e"]].std()
    x = np.column_stack([z["d"], z["e"], np.ones(n)])
    beta = np.linalg.lstsq(x, z["y"], rcond=None)[0]
    assert out["d"]["coefficient"] == pytest.approx(beta[0]) and out["e"]["coefficient"] == pytest.approx(beta[1])
    s2 = ((z["y"] - x @ beta) ** 2).sum() / (n - 3)
    assert out["d"]["std_error"] == pytest.approx(np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0]))
    assert out["d"]["p_value"] < 1e-6 and "k" not in out
