import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.functions.special import gamma_cdf, normal_quantile
from aridscape.operators import drought as D
from aridscape.operators import forecast as P
from aridscape.operators import yields as Y
from aridscape.plans.seasonal_forecast import seasonal_forecast
from aridscape.plans.spi_monitor import monitor, spi_at_scales

# A Mediterranean monthly rainfall climatology in mm.
CLIMATOLOGY = [110, 85, 70, 45, 25, 10, 3, 3, 15, 45, 80, 120]


def months(n, start=1960):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def series(spark, columns, region=1):
    n = len(next(iter(columns.values())))
    rows = list(zip([region] * n, months(n), *[[None if v is None or (isinstance(v, float) and np.isnan(v)) else float(v) for v in c] for c in columns.values()]))
    return spark.createDataFrame(rows, "region_id int, month date, " + ", ".join(f"{c} double" for c in columns))


@pytest.fixture(scope="module")
def rain(spark):
    rng = np.random.default_rng(7)
    v = np.array([rng.gamma(2, CLIMATOLOGY[i % 12] / 2) for i in range(720)])
    dry = np.isin(np.arange(720) % 12, [6, 7]) & (rng.random(720) < 0.5)
    v[dry] = 0.0
    return v, series(spark, {"ppt": v}).unionByName(series(spark, {"ppt": v * 3 + 1}, region=2)).cache()


@pytest.mark.parametrize("scale", [1, 3, 12])
def test_spi_is_standard_normal_per_region_and_month(rain, scale):
    _, df = rain
    out = D.spi(df, "ppt", scale).where("spi IS NOT NULL").toPandas()
    for _, part in out.groupby("region_id"):
        wet = part if scale > 1 else part[~part["month"].map(lambda m: m.month in (7, 8))]
        assert abs(wet["spi"].mean()) < 0.06
        assert 0.9 < wet["spi"].std() < 1.1
        monthly = wet.groupby(wet["month"].map(lambda m: m.month))["spi"].mean()
        assert monthly.abs().max() < 0.2
    assert len(out) == 2 * (720 - scale + 1)


def test_spi_equals_a_direct_computation(rain):
    v, df = rain
    got = D.spi(df.where("region_id = 1"), "ppt", 3).orderBy("month").toPandas()["spi"].to_numpy()
    acc = pd.Series(v).rolling(3).sum().to_numpy()
    k = np.arange(720) % 12 == 7
    x = acc[k]
    fit = D.gamma_fit(D.accumulate(df.where("region_id = 1"), "ppt", 3, "acc"), "acc").where("calendar_month = 8").first()
    pos = x[x > 0]
    q = (x <= 0).mean()
    assert fit["zero_fraction"] == pytest.approx(q)
    # the fitted shape is a stationary point of the likelihood
    loglik = lambda a: (a - 1) * np.log(pos).sum() - len(pos) * (a * np.log(pos.mean() / a)) - a * len(pos) - len(pos) * __import__("math").lgamma(a)
    assert loglik(fit["shape"]) >= max(loglik(fit["shape"] * 1.01), loglik(fit["shape"] * 0.99))
    h = np.where(x <= 0, q, q + (1 - q) * gamma_cdf(x / fit["scale"], np.full(x.shape, fit["shape"])))
    np.testing.assert_allclose(got[k], normal_quantile(np.clip(h, 1e-6, 1 - 1e-6)), atol=1e-9)


def test_spi_is_monotone_in_the_month_and_finite_at_zero(rain):
    _, df = rain
    out = D.spi(df, "ppt", 1).where("region_id = 1 AND month(month) = 7").orderBy("ppt").toPandas()
    assert out["spi"].notna().all() and (out["ppt"] == 0).any()
    assert out["spi"].is_monotonic_increasing


def test_calibration_is_applied_outside_its_span(rain):
    _, df = rain
    out = D.spi(df, "ppt", 3, calibration=("1960-01-01", "1999-12-31"))
    assert out.where("year(month) = 2015 AND spi IS NOT NULL").count() == 24


def test_a_short_region_is_a_rejection_and_leaves_the_others(rain):
    _, df = rain
    mixed = df.where("region_id <> 1 OR month < date '1975-01-01'")
    whole = {(r["region_id"], r["month"]): r["spi"] for r in D.spi(df, "ppt", 3).where("region_id <> 1").collect()}
    got = {(r["region_id"], r["month"]): r["spi"] for r in D.spi(mixed, "ppt", 3).collect()}
    assert got == whole
    assert [(r["region_id"], r["years"], r["reason"]) for r in D.spi_rejections(mixed, "ppt", 3).collect()] == [(1, 15, "calibration spans 15 years, at least 30 are needed")]
    span = ("1960-01-01", "1969-12-31")
    assert D.spi(df, "ppt", 3, calibration=span).count() == 0
    assert D.spi_rejections(df, "ppt", 3, calibration=span).count() == 2


def test_short_or_constant_months_get_no_index(spark):
    flat = series(spark, {"ppt": [50.0 + (i % 12 == 0) * (i // 12) for i in range(480)]})
    out = D.spi(flat, "ppt", 1).toPandas()
    by_month = out.groupby(out["month"].map(lambda m: m.month))["spi"].count()
    assert by_month[1] == 40 and by_month[2] == 0


def test_accumulation(spark):
    df = D.accumulate(series(spark, {"v": [1.0, 2.0, 3.0, 4.0]}), "v", 3, "a")
    assert [r["a"] for r in df.orderBy("month").collect()] == [None, None, 6.0, 9.0]
    with pytest.raises(ValueError):
        D.accumulate(df, "v", 0, "b")


def test_category_edges(spark):
    got = spark.createDataFrame([(v,) for v in (-2.0, -1.0, 0.5, 2.0, None)], "v double").select(D.spi_category(F.col("v"))).collect()
    assert [r[0] for r in got] == ["Şiddetli kurak", "Hafif kurak", "Hafif nemli", "Olağanüstü nemli", "veri yok"]


def test_events(spark):
    spi = [0.0] * 24
    spi[3:9] = [-1.5] * 6
    spi[15:17] = [-1.2, -1.0]
    events = D.drought_events(series(spark, {"spi": spi})).orderBy("position").collect()
    assert [(e["months"], e["lowest"], round(e["severity"], 6)) for e in events] == [(6, -1.5, -9.0), (2, -1.2, -2.2)]
    assert events[0]["start"] == dt.date(1960, 4, 1) and events[0]["end"] == dt.date(1960, 9, 1)


def test_events_follow_rows_unless_gaps_break_them(spark):
    gappy = series(spark, {"spi": [-2.0] * 6}).where("month <> date '1960-03-01'")
    assert D.drought_events(gappy).first()["months"] == 5
    assert sorted(r["months"] for r in D.drought_events(gappy, break_on_gap=True).collect()) == [2, 3]
    assert D.drought_events(series(spark, {"spi": [0.0, None]})).isEmpty()


def ar1(rho, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = rho * x[t - 1] + np.sqrt(1 - rho**2) * rng.normal()
    return x


def reference_skill(x, lead, fraction=0.7):
    cut = int(len(x) * fraction)
    s = pd.Series(x)
    train = s[:cut]
    rho = train.corr(train.shift(lead))
    truth = s[cut:]
    lag = s.shift(lead)[cut:]
    persist = truth.shift(lead)
    out = {}
    for name, p in (("climatology", truth * 0), ("persistence", lag), ("damped_persistence", lag * rho)):
        mse = ((p - truth) ** 2).mean()
        out[name] = (1 - mse / (truth**2).mean(), 1 - mse / ((persist - truth) ** 2).mean())
    return out


def test_benchmark_equals_a_plain_loop(spark):
    x = ar1(0.8, 400)
    got = {(r["method"], r["lead"]): r for r in P.benchmark(series(spark, {"v": x}), "v").collect()}
    assert len(got) == 9
    for lead in (1, 3, 6):
        for name, (clim, pers) in reference_skill(x, lead).items():
            row = got[(name, lead)]
            assert row["skill_vs_climatology"] == pytest.approx(clim, abs=1e-9)
            assert row["skill_vs_persistence"] == pytest.approx(pers, abs=1e-9)
    assert got[("climatology", 1)]["correlation"] == 0.0
    assert got[("damped_persistence", 6)]["rmse"] < got[("persistence", 6)]["rmse"]


def test_learned_damping_ignores_the_test_part(spark):
    x = ar1(0.8, 300)
    changed = x.copy()
    changed[210:] = np.random.default_rng(9).normal(size=90)
    split = P.chronological_split(series(spark, {"v": x}), "v").where("is_train")
    other = P.chronological_split(series(spark, {"v": changed}), "v").where("is_train")
    assert P.lag_correlation(split, "v", 1).first()["rho"] == P.lag_correlation(other, "v", 1).first()["rho"]
    assert split.agg(F.max("month")).first()[0] < P.chronological_split(series(spark, {"v": x}), "v").where("NOT is_train").agg(F.min("month")).first()[0]


def test_forecast_guards(spark):
    df = series(spark, {"v": ar1(0.5, 60)})
    with pytest.raises(ValueError, match="0.3..0.9"):
        P.chronological_split(df, "v", train_fraction=0.95)
    assert P.chronological_split(df, "v", train_fraction=0.3).count() == 0
    assert [(r["n_train"], r["n_test"]) for r in P.split_rejections(df, "v", train_fraction=0.3).collect()] == [(18, 42)]
    with pytest.raises(ValueError):
        P.lagged(df, "v", 0)
    short = series(spark, {"v": ar1(0.5, 10)})
    assert P.lag_correlation(short, "v", 1).first()["rho"] == 0.0


def test_hits_and_false_alarms(spark):
    rows = [(1, t, p) for t, p in zip([-1.5, -1.2, -1.1, 0.0, 0.3, 1.0], [-1.3, -1.0, 0.2, -1.4, 0.1, 0.5])]
    out = P.skill(spark.createDataFrame(rows, "k int, y double, p double").withColumn("ref", F.lit(None).cast("double")), "y", "p", "ref", keys=["k"]).first()
    assert (out["hit_rate"], out["false_alarm_ratio"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert out["skill_vs_persistence"] is None


@pytest.fixture(scope="module")
def climate(spark):
    """Winter store drives summer soil; two regions, one without the link."""
    out = None
    for region, link in ((1, 0.9), (2, 0.0)):
        rng = np.random.default_rng(region)
        ppt, soil, pdsi, pet = [], [], [], []
        store = 0.0
        for i in range(60 * 12):
            m = i % 12
            rain = rng.gamma(2, CLIMATOLOGY[m] / 2)
            if m == 10:
                store = 0.0
            if m in (10, 11, 0, 1, 2, 3):
                store += rain
            ppt.append(rain)
            base = link * store / 5 + (1 - link) * 100 + rng.normal(0, 5)
            soil.append(base if m in (2, 3, 6, 7, 8) else 50 + rng.normal())
            pdsi.append(rng.normal())
            pet.append(80 + rng.normal())
        part = series(spark, {"ppt": ppt, "soil": soil, "pdsi": pdsi, "pet": pet}, region)
        out = part if out is None else out.unionByName(part)
    return out.cache()


def test_planted_link_is_found_only_where_it_exists(climate):
    out = seasonal_forecast(climate)
    best = {r["region_id"]: r["predictor"] for r in out["best"].collect()}
    assert best[1] in ("wet_season_ppt", "spring_soil")
    skill = {(r["region_id"], r["predictor"]): r["skill_vs_climatology"] for r in out["skills"].collect()}
    assert skill[(1, "wet_season_ppt")] > 0.5 and skill[(2, "wet_season_ppt")] < 0.2
    described = {(r["region_id"], r["predictor"]): r for r in out["description"].collect()}
    assert described[(1, "wet_season_ppt")]["spearman"] > 0.7
    assert out["baselines"].count() == 4


def test_water_year_moves_november_forward(spark):
    df = series(spark, {"ppt": [1.0] * 24})
    got = {r["year"]: r["wet_season"] for r in P.water_year_total(df, "ppt").collect()}
    assert got == {1960: 4.0, 1961: 6.0, 1962: 2.0}


def test_seasonal_guards(climate):
    with pytest.raises(ValueError, match="overlap"):
        P.seasonal_dataset(climate, predictor_months=(6, 7))
    with pytest.raises(ValueError, match="must end before"):
        P.seasonal_dataset(climate, predictor_months=(10,))
    with pytest.raises(KeyError):
        P.seasonal_dataset(climate, target="yield")
    short = P.seasonal_dataset(climate.where("region_id <> 1 OR month < date '1975-01-01'"))
    assert P.seasonal_baselines(short).where("region_id = 1").count() == 0
    assert P.seasonal_baselines(short).where("region_id <> 1").count() == 2
    assert [r["region_id"] for r in P.split_rejections(short, "target", min_train=15, min_test=10).collect()] == [1]


def test_ridge_equals_the_closed_form_in_every_region(climate):
    data = P.seasonal_dataset(climate)
    skills, coefficients = P.ridge_skill(data.withColumn("spring_ppt", F.when(F.col("region_id") == 1, F.lit(2.0)).otherwise(F.col("spring_ppt"))))
    skills = {r["region_id"]: r for r in skills.collect()}
    beta_of = {(r["region_id"], r["predictor"]): r["coefficient"] for r in coefficients.collect()}
    for region, pdf in data.orderBy("year").toPandas().groupby("region_id"):
        if region == 1:
            pdf["spring_ppt"] = 2.0  # a constant predictor has no say
        cut = int(len(pdf) * 0.7)
        x, y = pdf[list(P.PREDICTORS)].to_numpy(), pdf["target"].to_numpy()
        spread = x[:cut].std(0)
        z = (x - x[:cut].mean(0)) / np.where(spread > 1e-12, spread, np.inf)
        beta = np.linalg.solve(z[:cut].T @ z[:cut] + np.eye(z.shape[1]), z[:cut].T @ (y[:cut] - y[:cut].mean()))
        np.testing.assert_allclose([beta_of[region, p] for p in P.PREDICTORS], beta, rtol=1e-6, atol=1e-12)
        error = z[cut:] @ beta + y[:cut].mean() - y[cut:]
        assert skills[region]["rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)
        assert skills[region]["n_test"] == len(pdf) - cut


def test_monitor_bundle(rain):
    _, df = rain
    out = monitor(spi_at_scales(df, scales=(3, 12)).cache())
    assert out["summary"].count() == 4 and out["state"].count() == 4
    assert out["skill"].count() == 18
    assert out["events"].where("position = 1").count() == 2


def test_annual_summary_ranks_and_ties(spark):
    df = series(spark, {"ppt": [1.0] * 12 + [2.0] * 12 + [1.0] * 12})
    rows = {r["year"]: r for r in D.annual_summary(df, "ppt").collect()}
    assert (rows[1960]["position"], rows[1961]["position"]) == (1, 3)
    assert rows[1961]["ratio_to_mean"] == 1.5
    assert [r["year"] for r in D.driest_years(D.annual_summary(df, "ppt"), 1).collect()] == [1960]


# --- yield ----------------------------------------------------------------------------


def crops(spark, rows):
    return spark.createDataFrame(rows, "crop string, year int, production double, area double")


def test_yield_checks(spark):
    checked = Y.checked_yield(crops(spark, [
        ("tahil", 2000, 5.0, 5.0), ("tahil", 2001, 30.0, 10.0), ("pamuk_lifi", 2001, 53.3, 10.0), ("uzum", 2001, 4.0, 0.0), ("misir", 2001, 900.0, 1.0),
    ]))
    got = {(r["crop"], r["year"]): (r["yield_t_ha"], r["reason"]) for r in checked.collect()}
    assert got[("tahil", 2000)] == (None, "production equals area")
    assert got[("tahil", 2001)] == (3.0, None)
    assert got[("pamuk_lifi", 2001)][1] == "outside plausible range"
    assert got[("uzum", 2001)] == (None, None)
    assert got[("misir", 2001)] == (900.0, None)
    assert Y.kept(checked).count() == 2
    assert {(r["crop"], r["years"]) for r in Y.rejections(checked).collect()} == {("tahil", "2000"), ("pamuk_lifi", "2001")}


def test_pure_trend_has_no_anomaly(spark):
    rng = np.random.default_rng(0)
    rows = [("trend", y, 2.0 + 0.05 * (y - 2000)) for y in range(2000, 2020)]
    rows += [("noisy", y, 2.0 + 0.05 * (y - 2000) + rng.normal(0, 0.4)) for y in range(2000, 2020)]
    rows += [("short", y, rng.normal()) for y in range(2000, 2005)]
    df = spark.createDataFrame([(c, y, float(v)) for c, y, v in rows], "crop string, year int, yield_t_ha double")
    out = Y.detrended_anomaly(df).toPandas()
    assert set(out["crop"]) == {"noisy"}
    assert abs(out["anomaly"].mean()) < 1e-9 and out["anomaly"].std() == pytest.approx(1)
    assert abs(np.polyfit(out["year"], out["anomaly"], 1)[0]) < 1e-9
    assert set(Y.detrended_anomaly(df, detrend=False).toPandas()["crop"]) == {"noisy", "trend"}


def test_area_fallback(spark):
    primary = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "crop string, year int, area double")
    spare = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 7.0)], "crop string, year int, area double")
    assert {r["year"]: r["area"] for r in Y.area_with_fallback(primary, spare).collect()} == {1: 5.0, 2: 7.0}
