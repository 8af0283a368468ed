"""Drought series, forecasts and crop yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from aridscape.operators import drought as D
from aridscape.operators import forecast as P
from aridscape.operators import yields as Y

from registry.views import query, r6, sql

_CATEGORY = """CASE WHEN {z} IS NULL THEN 'veri yok' WHEN {z} < -2 THEN 'Olağanüstü kurak' WHEN {z} < -1.5 THEN 'Şiddetli kurak' WHEN {z} < -1 THEN 'Orta kurak'
  WHEN {z} < -0.5 THEN 'Hafif kurak' WHEN {z} < 0.5 THEN 'Normale yakın' WHEN {z} < 1 THEN 'Hafif nemli' WHEN {z} < 1.5 THEN 'Orta nemli'
  WHEN {z} < 2 THEN 'Çok nemli' ELSE 'Olağanüstü nemli' END"""


@query("d01_accumulation", sql("climate", """SELECT region_id, "month", round(CASE WHEN count(ppt) OVER w = 3 THEN sum(ppt) OVER w END, 6) AS acc FROM climate
  WINDOW w AS (PARTITION BY region_id ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def _(v):
    return D.accumulate(v.climate, "ppt", 3, "acc").select("region_id", "month", r6("acc").alias("acc"))


@query("d02_zero_fraction", sql("zseries", """SELECT region_id, CAST(month("month") AS INT) AS calendar_month, count(*) AS n, round(avg(CASE WHEN z <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction FROM zseries GROUP BY 1, 2"""))
def _(v):
    return D.zero_fraction(v.zseries, "z").withColumn("zero_fraction", r6("zero_fraction"))


# Euler's psi and its derivative: eight steps up, then the asymptotic series
_Z = "(k + 8)"
_PSI = f"(ln({_Z}) - 0.5 / {_Z} - 1 / (12 * {_Z} ** 2) + 1 / (120 * {_Z} ** 4) - 1 / (252 * {_Z} ** 6) + 1 / (240 * {_Z} ** 8) - " + " - ".join(f"1 / (k + {i})" for i in range(8)) + ")"
_PSI1 = f"(1 / {_Z} + 0.5 / {_Z} ** 2 + 1 / (6 * {_Z} ** 3) - 1 / (30 * {_Z} ** 5) + 1 / (42 * {_Z} ** 7) + " + " + ".join(f"1 / (k + {i}) ** 2" for i in range(8)) + ")"


def _gamma_sql(source: str, min_values: int, min_positive: int = D.MIN_POSITIVE) -> str:
    """Maximum-likelihood shapes of ``source`` (region_id, month, acc) by Newton steps."""
    return f"""gsum AS (SELECT region_id, CAST(month("month") AS INT) AS calendar_month, count(*) AS n, count(*) FILTER (acc > 0) AS n_wet, avg(CASE WHEN acc <= 0 THEN 1.0 ELSE 0.0 END) AS zero_fraction,
    avg(acc) FILTER (acc > 0) AS mean_wet, ln(avg(acc) FILTER (acc > 0)) - avg(ln(CASE WHEN acc > 0 THEN acc END)) AS s, min(acc) FILTER (acc > 0) AS least, max(acc) FILTER (acc > 0) AS most
    FROM {source} WHERE acc IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {min_values}),
  gfit AS (SELECT *, CASE WHEN n_wet >= {min_positive} AND most - least > 1e-8 + 1e-5 * abs(least) THEN list_reduce(list_prepend((3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s), CAST(range(25) AS DOUBLE[])),
    lambda k, step: k - (ln(k) - {_PSI} - s) / (1 / k - {_PSI1})) END AS shape FROM gsum)"""


def spi_sql(series: str, scale: int, min_years: int, min_values: int) -> str:
    """Index values: incomplete gamma by its series, normal quantile by Newton steps on the upper half."""
    below = "exp(lgamma(j + 1.5) + (j + 1) * ln(2) - 0.5 * ln(pi()))"
    normal = f"(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(120), lambda j: z ** (2 * j + 1) / {below})))"
    floor = D.PROBABILITY_FLOOR
    return f"""sacc AS (SELECT region_id, "month", CASE WHEN count(ppt) OVER w = {scale} THEN sum(ppt) OVER w END AS acc FROM {series} WHERE ppt IS NOT NULL
    WINDOW w AS (PARTITION BY region_id ORDER BY "month" ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
  span AS (SELECT region_id, count(DISTINCT year("month")) FILTER (acc IS NOT NULL) AS years FROM sacc GROUP BY 1), {_gamma_sql("sacc", min_values)},
  prob AS (SELECT a.region_id, a."month", CASE WHEN acc <= 0 THEN zero_fraction ELSE zero_fraction + (1 - zero_fraction) * list_sum(list_transform(range(4000), lambda j:
      exp((shape + j) * ln(greatest(acc, 1e-300) / (mean_wet / shape)) - acc / (mean_wet / shape) - lgamma(shape + j + 1)))) END AS h, shape
    FROM sacc a JOIN span p ON p.region_id = a.region_id AND p.years >= {min_years} LEFT JOIN gfit g ON g.region_id = a.region_id AND calendar_month = month(a."month") AND acc IS NOT NULL),
  clip AS (SELECT region_id, "month", shape, least(greatest(h, {floor}), 1 - {floor}) AS h FROM prob),
  spi AS (SELECT region_id, "month", CASE WHEN shape IS NOT NULL THEN sign(h - 0.5) * list_reduce(list_prepend(0.0, CAST(range(40) AS DOUBLE[])),
    lambda z, step: z + (greatest(h, 1 - h) - {normal}) * exp(z * z / 2) * sqrt(2 * pi())) END AS spi FROM clip)"""


@query("d03_gamma_fit", sql("climate", "SELECT region_id, calendar_month, n, n_wet, round(zero_fraction, 6) AS zero_fraction, round(shape, 4) AS shape, round(mean_wet / shape, 6) AS scale FROM gfit",
  'cacc AS (SELECT region_id, "month", ppt AS acc FROM climate), ' + _gamma_sql("cacc", 5)))
def _(v):
    fit = D.gamma_fit(v.climate, "ppt", min_values=5)
    return fit.select("region_id", "calendar_month", "n", "n_wet", r6("zero_fraction").alias("zero_fraction"), F.round("shape", 4).alias("shape"), r6("scale").alias("scale"))


@query("d03_gamma_statistics", sql("climate", """SELECT region_id, CAST(month("month") AS INT) AS calendar_month, count(*) AS n, count(*) FILTER (ppt > 0) AS n_wet, round(avg(CASE WHEN ppt <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction,
  round(avg(ppt) FILTER (ppt > 0), 6) AS mean_wet FROM climate GROUP BY 1, 2 HAVING count(*) >= 5"""))
def _(v):
    fit = D.gamma_fit(v.climate, "ppt", min_values=5)
    return fit.select("region_id", "calendar_month", "n", "n_wet", r6("zero_fraction").alias("zero_fraction"), r6(F.col("shape") * F.col("scale")).alias("mean_wet"))


@query("d04_spi", sql("climate", 'SELECT region_id, "month", round(spi, 6) + 0.0 AS spi FROM spi', spi_sql("climate", 3, 5, 5)))
def _(v):
    return D.spi(v.climate, "ppt", 3, min_years=5, min_values=5).select("region_id", "month", r6("spi").alias("spi"))


def _with_short_region(v):
    """The climate and one more region that ends after its first years."""
    return v.climate.unionByName(v.climate.where("region_id = 1 AND month < date '1998-01-01'").withColumn("region_id", F.lit(100).cast("bigint")))


_SHORT = """shortened AS (SELECT region_id, "month", ppt, soil FROM climate UNION ALL SELECT 100, "month", ppt, soil FROM climate WHERE region_id = 1 AND "month" < DATE '1998-01-01')"""


@query("d04_spi_beside_a_short_region", sql("climate", 'SELECT region_id, "month", round(spi, 6) + 0.0 AS spi FROM spi', _SHORT + ", " + spi_sql("shortened", 3, 5, 5)))
def _(v):
    return D.spi(_with_short_region(v), "ppt", 3, min_years=5, min_values=5).select("region_id", "month", r6("spi").alias("spi"))


@query("d04_rejections", sql("climate", """SELECT region_id, count(DISTINCT year("month")) FILTER (acc IS NOT NULL) AS years, 'calibration spans ' || count(DISTINCT year("month")) FILTER (acc IS NOT NULL) || ' years, at least 5 are needed' AS reason FROM (
  SELECT region_id, "month", CASE WHEN count(ppt) OVER w = 3 THEN sum(ppt) OVER w END AS acc FROM shortened WINDOW w AS (PARTITION BY region_id ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  GROUP BY 1 HAVING count(DISTINCT year("month")) FILTER (acc IS NOT NULL) < 5""", _SHORT))
def _(v):
    return D.spi_rejections(_with_short_region(v), "ppt", 3, min_years=5)


@query("d05_category", sql("zseries", f'SELECT region_id, "month", {_CATEGORY.format(z="z")} AS category FROM zseries'))
def _(v):
    return v.zseries.select("region_id", "month", D.spi_category(F.col("z")).alias("category"))


@query("d06_summary", sql("zseries", """SELECT region_id, count(*) AS n, round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 6) AS std, min(z) AS "min", max(z) AS "max",
  round(avg(CASE WHEN z <= -1 THEN 1.0 ELSE 0.0 END), 6) AS drought_share, round(avg(CASE WHEN z <= -1.5 THEN 1.0 ELSE 0.0 END), 6) AS severe_share FROM zseries GROUP BY 1"""))
def _(v):
    out = D.spi_summary(v.zseries, "z")
    return out.select("region_id", "n", "min", "max", *[r6(c).alias(c) for c in ("mean", "std", "drought_share", "severe_share")])


@query("d07_events", sql("zseries", """SELECT region_id, "start", "end", months, lowest, round(severity, 6) AS severity, CAST(row_number() OVER (PARTITION BY region_id ORDER BY round(severity, 9), "start") AS INT) AS position FROM (
  SELECT region_id, min("month") AS "start", max("month") AS "end", count(*) AS months, min(z) AS lowest, sum(z) AS severity FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY "month") - row_number() OVER (PARTITION BY region_id, z <= -0.5 ORDER BY "month") AS island FROM zseries) WHERE z <= -0.5 GROUP BY region_id, island)"""))
def _(v):
    events = D.drought_events(v.zseries, "z", threshold=-0.5)
    return events.withColumn("severity", r6("severity"))


@query("d08_cross_check", sql("zseries", "SELECT region_id, count(*) AS n, round(CASE WHEN count(*) >= 60 THEN corr(z, pdsi) END, 6) AS r FROM zseries GROUP BY 1"))
def _(v):
    return D.cross_check(v.zseries, "z", "pdsi", min_months=60).withColumn("r", r6("r"))


_ANNUAL = """annual AS (SELECT region_id, "year", round(total, 1) AS total, round(total / avg(total) OVER (PARTITION BY region_id), 3) AS ratio_to_mean,
  CAST(floor(rank() OVER (PARTITION BY region_id ORDER BY round(total, 9)) + (count(*) OVER (PARTITION BY region_id, round(total, 9)) - 1) / 2.0) AS INT) AS position
  FROM (SELECT region_id, CAST(year("month") AS INT) AS "year", sum(ppt) AS total FROM climate GROUP BY 1, 2))"""


@query("d09_annual_summary", sql("climate", 'SELECT region_id, "year", total, ratio_to_mean, position FROM annual', _ANNUAL))
def _(v):
    return D.annual_summary(v.climate, "ppt")


@query("d10_driest_years", sql("climate", 'SELECT region_id, "year", total, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY total, "year") AS k FROM annual) WHERE k <= 5', _ANNUAL))
def _(v):
    return D.driest_years(D.annual_summary(v.climate, "ppt"), 5).select("region_id", "year", "total", "k")


@query("d11_current_state", sql("zseries", f'SELECT region_id, arg_max(z, "month") AS value, max("month") AS "month", {_CATEGORY.format(z="arg_max(z, zseries.month)")} AS category FROM zseries GROUP BY 1'))
def _(v):
    return D.current_state(v.zseries, "z")


@query("d12_climatology", sql("climate", """SELECT region_id, round(avg(m) FILTER (k IN (7, 8)), 6) AS summer, round(avg(m) FILTER (k IN (12, 1, 2)), 6) AS winter,
  round(avg(m) FILTER (k IN (12, 1, 2)) / greatest(avg(m) FILTER (k IN (7, 8)), 0.1), 6) AS winter_to_summer FROM (SELECT region_id, month("month") AS k, avg(ppt) AS m FROM climate GROUP BY 1, 2) GROUP BY 1"""))
def _(v):
    out = D.season_contrast(D.monthly_climatology(v.climate, "ppt"))
    return out.select("region_id", *[r6(c).alias(c) for c in ("summer", "winter", "winter_to_summer")])


@query("d12_monthly_means", sql("climate", 'SELECT region_id, CAST(month("month") AS INT) AS calendar_month, round(avg(ppt), 6) AS mean FROM climate GROUP BY 1, 2'))
def _(v):
    return D.monthly_climatology(v.climate, "ppt").withColumn("mean", r6("mean"))


# --- forecasting -------------------------------------------------------------------

_SPLIT = """split AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY "month") AS t, CAST(floor(count(*) OVER (PARTITION BY region_id) * 0.6) AS INT) AS cut FROM zseries),
lags AS (SELECT s.*, l.lead, p.z AS lag FROM split s JOIN (VALUES (1), (3), (6)) l(lead) ON true LEFT JOIN split p ON p.region_id = s.region_id AND p.t = s.t - l.lead),
rho AS (SELECT region_id, lead, CASE WHEN count(lag) >= 12 THEN corr(z, lag) ELSE 0 END AS rho FROM lags WHERE t <= cut GROUP BY 1, 2),
preds AS (SELECT l.region_id, l.lead, m.method, z AS y, CASE m.method WHEN 'climatology' THEN 0.0 WHEN 'persistence' THEN lag ELSE lag * rho END AS p,
  CASE WHEN t > cut + l.lead THEN lag END AS ref FROM lags l JOIN rho r ON r.region_id = l.region_id AND r.lead = l.lead,
  (VALUES ('climatology'), ('persistence'), ('damped_persistence')) m(method) WHERE t > cut),
skill AS (SELECT region_id, method, CAST(lead AS INT) AS lead, count(*) AS n, round(CASE WHEN stddev_pop(p) > 0 THEN corr(y, p) ELSE 0 END, 6) AS correlation, round(sqrt(avg((p - y) ** 2)), 6) AS rmse,
  round(avg(abs(p - y)), 6) AS mae, round(1 - avg((p - y) ** 2) / avg(y * y), 6) + 0.0 AS skill_vs_climatology, round(1 - avg((p - y) ** 2) / avg((ref - y) ** 2), 6) + 0.0 AS skill_vs_persistence,
  round(count(*) FILTER (p <= -0.5 AND y <= -0.5) / nullif(count(*) FILTER (y <= -0.5), 0), 6) AS hit_rate,
  round(count(*) FILTER (p <= -0.5 AND y > -0.5) / nullif(count(*) FILTER (p <= -0.5), 0), 6) AS false_alarm_ratio FROM preds GROUP BY 1, 2, 3)"""


@query("f01_chronological_split", sql("zseries", 'SELECT region_id, "month", t <= cut AS is_train FROM split', _SPLIT))
def _(v):
    return P.chronological_split(v.zseries, "z", train_fraction=0.6).select("region_id", "month", "is_train")


def _benchmark(v):
    out = P.benchmark(v.zseries, "z", train_fraction=0.6, drought=-0.5)
    floats = [c for c in out.columns if c not in ("region_id", "method", "lead", "n")]
    return out.select("region_id", "method", "lead", "n", *[r6(c).alias(c) for c in floats])


@query("f01_rejections", sql("climate", """SELECT region_id, CAST(floor(n * 0.6) AS BIGINT) AS n_train, n - CAST(floor(n * 0.6) AS BIGINT) AS n_test FROM (SELECT region_id, count(soil) AS n FROM shortened GROUP BY 1)
  WHERE floor(n * 0.6) < 24 OR n - floor(n * 0.6) < 24""", _SHORT))
def _(v):
    return P.split_rejections(_with_short_region(v), "soil", train_fraction=0.6).drop("reason")


for _name, _method in (("f02_climatology", "climatology"), ("f03_persistence_skill", "persistence"), ("f05_damped_persistence", "damped_persistence")):
    query(_name, sql("zseries", f"SELECT * FROM skill WHERE method = '{_method}'", _SPLIT))(lambda v, m=_method: _benchmark(v).where(F.col("method") == m))


@query("f03_persistence", sql("zseries", 'SELECT region_id, "month", lag FROM lags WHERE lead = 3', _SPLIT))
def _(v):
    return v.zseries.select("region_id", "month", P.lagged(v.zseries, "z", 3).alias("lag"))


@query("f04_lag_correlation", sql("zseries", "SELECT region_id, round(rho, 6) AS rho FROM rho WHERE lead = 3", _SPLIT))
def _(v):
    train = P.chronological_split(v.zseries, "z", train_fraction=0.6).where("is_train")
    return P.lag_correlation(train, "z", 3).withColumn("rho", r6("rho"))


@query("f06_skill", sql("zseries", """SELECT region_id, count(*) AS n, round(corr(z, pdsi), 6) AS correlation, round(sqrt(avg((pdsi - z) ** 2)), 6) AS rmse, round(avg(abs(pdsi - z)), 6) AS mae,
  round(1 - avg((pdsi - z) ** 2) / avg(z * z), 6) AS skill_vs_climatology, round(1 - avg((pdsi - z) ** 2) / avg((prev - z) ** 2), 6) AS skill_vs_persistence,
  round(count(*) FILTER (pdsi <= 4.5 AND z <= 4.5) / nullif(count(*) FILTER (z <= 4.5), 0), 6) AS hit_rate, round(count(*) FILTER (pdsi <= 4.5 AND z > 4.5) / nullif(count(*) FILTER (pdsi <= 4.5), 0), 6) AS false_alarm_ratio
  FROM (SELECT *, lag(z) OVER (PARTITION BY region_id ORDER BY "month") AS prev FROM zseries) GROUP BY 1"""))
def _(v):
    rows = v.zseries.withColumn("prev", P.lagged(v.zseries, "z", 1))
    out = P.skill(rows, "z", "pdsi", "prev", keys=["region_id"], drought=4.5)
    return out.select("region_id", "n", *[r6(c).alias(c) for c in out.columns if c not in ("region_id", "n")])


@query("f07_benchmark", sql("zseries", "SELECT * FROM skill", _SPLIT))
def _(v):
    return _benchmark(v)


@query("f08_seasonal_summary", sql("climate", 'SELECT region_id, CAST(year("month") AS INT) AS "year", round(avg(soil), 6) AS soil FROM climate WHERE month("month") IN (7, 8, 9) GROUP BY 1, 2'))
def _(v):
    return P.seasonal_summary(v.climate, "soil", (7, 8, 9)).withColumn("soil", r6("soil"))


@query("f09_water_year", sql("climate", """SELECT region_id, CAST(year("month") + CASE WHEN month("month") >= 11 THEN 1 ELSE 0 END AS INT) AS "year", round(sum(ppt), 6) AS wet_season
  FROM climate WHERE month("month") IN (11, 12, 1, 2, 3, 4) GROUP BY 1, 2"""))
def _(v):
    return P.water_year_total(v.climate, "ppt").withColumn("wet_season", r6("wet_season"))


_SEASONAL = """wy AS (SELECT region_id, year("month") + CASE WHEN month("month") >= 11 THEN 1 ELSE 0 END AS y, sum(ppt) AS wet_season_ppt FROM climate WHERE month("month") IN (11, 12, 1, 2, 3, 4) GROUP BY 1, 2),
spring AS (SELECT region_id, year("month") AS y, sum(ppt) AS spring_ppt, avg(soil) AS spring_soil, avg(pdsi) AS spring_pdsi, sum(pet) AS spring_pet FROM climate WHERE month("month") IN (3, 4) GROUP BY 1, 2),
summer AS (SELECT region_id, year("month") AS y, avg(soil) AS target FROM climate WHERE month("month") IN (7, 8, 9) GROUP BY 1, 2),
dataset AS (SELECT region_id, CAST(y AS INT) AS "year", wet_season_ppt, spring_ppt, spring_soil, spring_pdsi, spring_pet, target FROM summer JOIN (wy FULL JOIN spring USING (region_id, y)) USING (region_id, y)),
ssplit AS (SELECT *, row_number() OVER w AS t, CAST(floor(count(*) OVER (PARTITION BY region_id) * 0.6) AS INT) AS cut, lag(target) OVER w AS prev FROM dataset WINDOW w AS (PARTITION BY region_id ORDER BY "year")),
sref AS (SELECT *, avg(target) FILTER (t <= cut) OVER (PARTITION BY region_id) AS tm FROM ssplit),
base AS (SELECT region_id, avg((target - prev) ** 2) AS mp FROM sref WHERE t > cut GROUP BY 1),
tall AS (UNPIVOT sref ON wet_season_ppt, spring_ppt, spring_soil, spring_pdsi, spring_pet INTO NAME predictor VALUE x),
fit AS (SELECT region_id, predictor, regr_slope(target, x) AS slope, regr_intercept(target, x) AS intercept FROM tall WHERE t <= cut GROUP BY 1, 2),
uni AS (SELECT region_id, predictor, count(*) AS n_test, slope, intercept, corr(target, slope * x + intercept) AS correlation, sqrt(avg((target - slope * x - intercept) ** 2)) AS rmse,
  1 - avg((target - slope * x - intercept) ** 2) / avg((target - tm) ** 2) AS skill_vs_climatology, 1 - avg((target - slope * x - intercept) ** 2) / any_value(mp) AS skill_vs_persistence
  FROM tall JOIN fit USING (region_id, predictor) JOIN base USING (region_id) WHERE t > cut GROUP BY region_id, predictor, slope, intercept)"""


def _dataset(v):
    return P.seasonal_dataset(v.climate)


@query("f10_seasonal_dataset", sql("climate", 'SELECT region_id, "year", round(wet_season_ppt, 6) AS wet_season_ppt, round(spring_ppt, 6) AS spring_ppt, round(spring_soil, 6) AS spring_soil, round(spring_pdsi, 6) AS spring_pdsi, spring_pet, round(target, 6) AS target FROM dataset', _SEASONAL))
def _(v):
    return _dataset(v).select("region_id", "year", "spring_pet", *[r6(c).alias(c) for c in ("wet_season_ppt", "spring_ppt", "spring_soil", "spring_pdsi", "target")])


@query("f11_predictor_description", sql("climate", """SELECT region_id, predictor, count(*) AS n, round(corr(x, target), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (
  SELECT *, rank() OVER (PARTITION BY region_id, predictor ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY region_id, predictor, round(x, 9)) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY region_id, predictor ORDER BY round(target, 9)) AS ry FROM tall) GROUP BY 1, 2""", _SEASONAL))
def _(v):
    out = P.describe_predictors(_dataset(v))
    return out.select("region_id", "predictor", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("f12_seasonal_baselines", sql("climate", """SELECT region_id, 'climatology' AS method, count(*) AS n_test, 0.0::DOUBLE AS correlation, round(sqrt(avg((target - tm) ** 2)), 6) AS rmse, 0.0::DOUBLE AS skill_vs_climatology,
  round(1 - avg((target - tm) ** 2) / avg((target - prev) ** 2), 6) AS skill_vs_persistence FROM sref WHERE t > cut GROUP BY 1
  UNION ALL SELECT region_id, 'persistence', count(prev), round(corr(target, prev), 6), round(sqrt(avg((target - prev) ** 2)), 6), round(1 - avg((target - prev) ** 2) / avg((target - tm) ** 2), 6), 0.0 FROM sref WHERE t > cut GROUP BY 1""", _SEASONAL))
def _(v):
    out = P.seasonal_baselines(_dataset(v), train_fraction=0.6, min_train=3, min_test=2)
    return out.select("region_id", "method", "n_test", *[r6(c).alias(c) for c in ("correlation", "rmse", "skill_vs_climatology", "skill_vs_persistence")])


def _univariate(v):
    return P.univariate_skill(_dataset(v), train_fraction=0.6, min_train=3, min_test=2, min_fit=3, min_score=2)


_ROUNDED = "region_id, predictor, n_test, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(correlation, 6) AS correlation, round(rmse, 6) AS rmse, round(skill_vs_climatology, 6) AS skill_vs_climatology, round(skill_vs_persistence, 6) AS skill_vs_persistence"


@query("f13_univariate_skill", sql("climate", f"SELECT {_ROUNDED} FROM uni", _SEASONAL))
def _(v):
    out = _univariate(v)
    return out.select("region_id", "predictor", "n_test", *[r6(c).alias(c) for c in out.columns if c not in ("region_id", "predictor", "n_test")])


def _yearly(v, region=None):
    """Months as one long series of years per region (return flag and line status by default)."""
    lines = v.table("lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    if region is None:  # one region ends early
        region = F.concat("l_returnflag", "l_linestatus")
        lines = lines.where((region != "NO") | (F.year("l_shipdate") < 1997))
    return lines.groupBy(region.alias("region_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("year")).agg(
        F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.avg("l_extendedprice").alias("target")
    )


_EARLY = "l_returnflag || l_linestatus <> 'NO' OR year(l_shipdate) < 1997"


def _ridge_sql(region: str, kept: str = "true") -> str:
    """Ridge in closed form: Cramer's rule on the 3x3 normal equations of standardised inputs, per region."""
    centred = ", ".join(f"coalesce(({c} - avg({c}) FILTER (t <= cut) OVER w) / nullif(stddev_pop({c}) FILTER (t <= cut) OVER w, 0), 0) AS z{c}" for c in "abc")
    return f"""ym AS (SELECT {region} AS region_id, year(l_shipdate) * 12 + month(l_shipdate) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, avg(l_extendedprice) AS target FROM lineitem WHERE {kept} GROUP BY 1, 2),
ys AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY y) AS t, floor(count(*) OVER (PARTITION BY region_id) * 0.7) AS cut, count(*) OVER (PARTITION BY region_id) AS total,
  lag(target) OVER (PARTITION BY region_id ORDER BY y) AS prev FROM ym),
yz AS (SELECT *, {centred}, avg(target) FILTER (t <= cut) OVER w AS tm, target - avg(target) FILTER (t <= cut) OVER w AS zy FROM ys WHERE cut >= 15 AND total - cut >= 10 WINDOW w AS (PARTITION BY region_id)),
ne AS (SELECT region_id, count(*) AS n_train, sum(za * za) + 1 AS aa, sum(za * zb) AS ab, sum(za * zc) AS ac, sum(zb * zb) + 1 AS bb, sum(zb * zc) AS bc, sum(zc * zc) + 1 AS cc, sum(za * zy) AS ay, sum(zb * zy) AS bby, sum(zc * zy) AS cy FROM yz WHERE t <= cut GROUP BY 1),
co AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (bby * cc - bc * cy) + ac * (bby * bc - bb * cy)) / det AS ca, (aa * (bby * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bby * ac)) / det AS cb,
  (aa * (bb * cy - bby * bc) - ab * (ab * cy - bby * ac) + ay * (ab * bc - bb * ac)) / det AS cc_ FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM ne)),
sk AS (SELECT region_id, n_train, count(*) AS n_test, corr(target, p) AS correlation, sqrt(avg((target - p) ** 2)) AS rmse, 1 - avg((target - p) ** 2) / avg((target - tm) ** 2) AS skill_vs_climatology,
  1 - avg((target - p) ** 2) / avg((target - prev) ** 2) AS skill_vs_persistence FROM (SELECT yz.*, n_train, tm + ca * za + cb * zb + cc_ * zc AS p FROM yz JOIN co USING (region_id) WHERE t > cut) GROUP BY 1, 2)"""


_COEFFICIENTS = " UNION ALL ".join(f"SELECT {{region}} '{p}' AS predictor, round({c}, 4) AS coefficient FROM co" for p, c in (("a", "ca"), ("b", "cb"), ("c", "cc_")))
_SKILLS = ("correlation", "rmse", "skill_vs_climatology", "skill_vs_persistence")


@query("f14_ridge", sql("", _COEFFICIENTS.format(region=""), _ridge_sql("0")))
def _(v):
    _skills, coefficients = P.ridge_skill(_yearly(v, F.lit(0)), ["a", "b", "c"])
    return coefficients.select("predictor", F.round("coefficient", 4).alias("coefficient"))


@query("f14_ridge_skill", sql("", "SELECT n_test, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SKILLS) + " FROM sk", _ridge_sql("0")))
def _(v):
    skills, _coefficients = P.ridge_skill(_yearly(v, F.lit(0)), ["a", "b", "c"])
    return skills.select("n_test", *[r6(c).alias(c) for c in _SKILLS])


@query("f14_ridge_by_region", sql("", _COEFFICIENTS.format(region="region_id,"), _ridge_sql("l_returnflag || l_linestatus", _EARLY)))
def _(v):
    _skills, coefficients = P.ridge_skill(_yearly(v), ["a", "b", "c"])
    return coefficients.select("region_id", "predictor", F.round("coefficient", 4).alias("coefficient"))


@query("f14_ridge_skill_by_region", sql("", "SELECT region_id, n_train, n_test, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SKILLS) + " FROM sk", _ridge_sql("l_returnflag || l_linestatus", _EARLY)))
def _(v):
    skills, _coefficients = P.ridge_skill(_yearly(v), ["a", "b", "c"])
    return skills.select("region_id", "n_train", "n_test", *[r6(c).alias(c) for c in _SKILLS])


@query("f14_rejections", sql("", f"""SELECT region_id, CAST(floor(n * 0.7) AS BIGINT) AS n_train, n - CAST(floor(n * 0.7) AS BIGINT) AS n_test FROM (
  SELECT l_returnflag || l_linestatus AS region_id, count(DISTINCT year(l_shipdate) * 12 + month(l_shipdate)) AS n FROM lineitem WHERE {_EARLY} GROUP BY 1) WHERE floor(n * 0.7) < 15 OR n - floor(n * 0.7) < 10"""))
def _(v):
    return P.split_rejections(_yearly(v), "target", min_train=15, min_test=10).drop("reason")


@query("f15_best_predictor", sql("climate", f"""SELECT {_ROUNDED} FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(skill_vs_climatology, 9) DESC, predictor) AS k
  FROM uni WHERE skill_vs_climatology > 0 AND skill_vs_persistence > 0) WHERE k = 1""", _SEASONAL))
def _(v):
    out = P.best_predictor(_univariate(v))
    return out.select("region_id", "predictor", "n_test", *[r6(c).alias(c) for c in ("slope", "intercept", "correlation", "rmse", "skill_vs_climatology", "skill_vs_persistence")])


# --- crop yield ----------------------------------------------------------------------

_LIMITS = {"Brand#1": (54.9, 55.3), "Brand#2": (0.0, 55.1)}


@query("y01_area_fallback", sql("crop", """SELECT a.crop, a."year", coalesce(CASE WHEN a."year" % 2 = 0 THEN a.area END, a.production / 50) AS area FROM crop a"""))
def _(v):
    primary = v.crop.select("crop", "year", F.when(F.col("year") % 2 == 0, F.col("area")).alias("area"))
    spare = v.crop.select("crop", "year", (F.col("production") / 50).alias("area"))
    return Y.area_with_fallback(primary, spare).select("crop", "year", "area")


_CHECKED = """checked AS (SELECT *, CASE WHEN p = q THEN 'production equals area' WHEN crop = 'Brand#1' AND (p / q < 54.9 OR p / q > 55.3) THEN 'outside plausible range'
  WHEN crop = 'Brand#2' AND (p / q < 0 OR p / q > 55.1) THEN 'outside plausible range' WHEN p / q < 0 THEN 'outside plausible range' END AS reason FROM (
  SELECT crop, "year", CASE WHEN "year" = 1997 AND crop = 'Brand#3' THEN area ELSE production END AS p, CASE WHEN "year" = 1998 THEN NULL ELSE area END AS q FROM crop))"""


def _checked(v):
    table = v.crop.select(
        "crop", "year",
        F.when((F.col("year") == 1997) & (F.col("crop") == "Brand#3"), F.col("area")).otherwise(F.col("production")).alias("production"),
        F.when(F.col("year") == 1998, 0.0).otherwise(F.col("area")).alias("area"),
    )
    return Y.checked_yield(table, limits=_LIMITS)


@query("y02_checked_yield", sql("crop", 'SELECT crop, "year", round(p / q, 6) AS yield_t_ha FROM checked WHERE reason IS NULL AND q IS NOT NULL', _CHECKED))
def _(v):
    return Y.kept(_checked(v)).select("crop", "year", r6("yield_t_ha").alias("yield_t_ha"))


@query("y03_rejections", sql("crop", """SELECT reason, crop, count(*) AS n, string_agg(CAST("year" AS VARCHAR), ',' ORDER BY "year") AS years FROM checked WHERE reason IS NOT NULL GROUP BY 1, 2""", _CHECKED))
def _(v):
    return Y.rejections(_checked(v))


@query("y04_detrended_anomaly", sql("crop", """SELECT crop, "year", round(res, 6) + 0.0 AS residual, round((res - avg(res) OVER w) / stddev_samp(res) OVER w, 6) + 0.0 AS anomaly FROM (
  SELECT crop, "year", y - my - slope * ("year" - mx) AS res FROM (SELECT crop, "year", production / area AS y FROM crop) JOIN
  (SELECT crop, avg("year") AS mx, avg(production / area) AS my, regr_slope(production / area, "year") AS slope FROM crop GROUP BY 1 HAVING count(*) >= 5) USING (crop)) WINDOW w AS (PARTITION BY crop)"""))
def _(v):
    series = v.crop.select("crop", "year", (F.col("production") / F.col("area")).alias("yield_t_ha"))
    out = Y.detrended_anomaly(series, min_years=5)
    return out.select("crop", "year", r6("residual").alias("residual"), r6("anomaly").alias("anomaly"))
