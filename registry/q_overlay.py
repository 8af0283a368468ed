"""Weighting, overlay and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from aridscape.operators import classify as K
from aridscape.operators import keyed as G
from aridscape.operators import overlay as O
from aridscape.operators import weighting as A
from aridscape.operators.normalize import Criterion, score_layers

from registry.views import LABELS, NAMES, WEIGHTS, query, r6, r9, sql


def _matrix(v):
    upper = v.judgements.select("respondent", "i", "j", A.decode_answer(F.col("answer")).alias("a"))
    return A.full_matrix(upper)


@query("a01_matrix_check", sql("matrix", """SELECT a.respondent, 'reciprocity' AS rule, a.i, a.j, round(a.v * b.v, 6) AS value FROM
  (SELECT *, CASE WHEN respondent % 9 = 0 AND i = 0 AND j = 1 THEN a * 1.5 ELSE a END AS v FROM matrix) a JOIN (SELECT *, a AS v FROM matrix) b
  ON a.respondent = b.respondent AND a.i = b.j AND a.j = b.i WHERE a.i < a.j AND abs(a.v * b.v - 1) > 0.002
  UNION ALL SELECT respondent, 'diagonal', i, j, 1.25 FROM matrix WHERE respondent % 13 = 0 AND i = 4 AND j = 4"""))
def _(v):
    broken = _matrix(v).withColumn(
        "a",
        F.when((F.col("respondent") % 9 == 0) & (F.col("i") == 0) & (F.col("j") == 1), F.col("a") * 1.5)
        .when((F.col("respondent") % 13 == 0) & (F.col("i") == 4) & (F.col("j") == 4), 1.25)
        .otherwise(F.col("a")),
    )
    return A.matrix_violations(broken).withColumn("value", r6("value"))


# power iteration in SQL, an independent route to the same eigenpair
_POWER = """flat AS (SELECT respondent, list(a ORDER BY i, j) AS m FROM matrix GROUP BY 1),
power AS (WITH RECURSIVE it AS (SELECT respondent, m, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] AS w, 0 AS k FROM flat UNION ALL
  SELECT respondent, m, list_transform(p, lambda x: x / list_sum(p)) AS w, k + 1 FROM (SELECT respondent, m, k,
    list_transform([0, 1, 2, 3, 4], lambda i: m[i * 5 + 1] * w[1] + m[i * 5 + 2] * w[2] + m[i * 5 + 3] * w[3] + m[i * 5 + 4] * w[4] + m[i * 5 + 5] * w[5]) AS p FROM it WHERE k < 200))
  SELECT respondent, w, list_sum(list_transform([0, 1, 2, 3, 4], lambda i: (m[i * 5 + 1] * w[1] + m[i * 5 + 2] * w[2] + m[i * 5 + 3] * w[3] + m[i * 5 + 4] * w[4] + m[i * 5 + 5] * w[5]))) AS lambda_max
  FROM it WHERE k = 200)"""


@query("a02_eigen_weights", sql("matrix", """SELECT respondent, CAST(i - 1 AS INT) AS i, round(w[i], 6) AS weight, round(lambda_max, 6) AS lambda_max FROM power, range(1, 6) r(i)""", _POWER))
def _(v):
    solved = A.solve(_matrix(v))
    return A.weight_rows(solved, keys=["respondent", "lambda_max"]).select("respondent", "i", r6("weight").alias("weight"), r6("lambda_max").alias("lambda_max"))


@query("a03_geometric_weights", sql("matrix", """SELECT respondent, i, round(g / sum(g) OVER (PARTITION BY respondent), 6) AS weight FROM
  (SELECT respondent, i, exp(avg(ln(a))) AS g FROM matrix GROUP BY 1, 2)"""))
def _(v):
    return A.geometric_weights(_matrix(v)).withColumn("weight", r6("weight"))


@query("a03_method_gap", sql("matrix", """SELECT respondent, round(max(abs(w[i + 1] - g)), 6) AS max_gap FROM power JOIN (SELECT respondent, i, g / sum(g) OVER (PARTITION BY respondent) AS g FROM
  (SELECT respondent, i, exp(avg(ln(a))) AS g FROM matrix GROUP BY 1, 2)) USING (respondent) GROUP BY 1""", _POWER))
def _(v):
    matrix = _matrix(v)
    return A.method_gap(A.solve(matrix), A.geometric_weights(matrix)).withColumn("max_gap", r6("max_gap"))


@query("a04_consistency", sql("matrix", "SELECT respondent, CAST(5 AS INT) AS n, round((lambda_max - 5) / 4, 6) AS ci, CAST(1.12 AS DOUBLE) AS ri, round((lambda_max - 5) / 4 / 1.12, 6) AS cr FROM power", _POWER))
def _(v):
    return A.solve(_matrix(v)).select("respondent", "n", r6("ci").alias("ci"), "ri", r6("cr").alias("cr"))


@query("a05_accept", sql("matrix", "SELECT accepted, count(*) AS respondents FROM (SELECT (lambda_max - 5) / 4 / 1.12 <= 1.5 AS accepted FROM power) GROUP BY 1", _POWER))
def _(v):
    return A.solve(_matrix(v), max_cr=1.5).groupBy("accepted").agg(F.count("*").alias("respondents"))


@query("a06_ranked_weights", sql("matrix", """SELECT respondent, i, CAST(row_number() OVER (PARTITION BY respondent ORDER BY round(g, 9) DESC, i) AS INT) AS position FROM
  (SELECT respondent, i, g / sum(g) OVER (PARTITION BY respondent) AS g FROM (SELECT respondent, i, exp(avg(ln(a))) AS g FROM matrix GROUP BY 1, 2))"""))
def _(v):
    weights = A.geometric_weights(_matrix(v)).withColumn("weight", r9(F.col("weight")))
    return A.ranked(weights).select("respondent", "i", "position")


_SETS = """base AS (SELECT respondent, i, ['precip','ndvi_dry','soil','lst','slope'][i + 1] AS name, g / sum(g) OVER (PARTITION BY respondent) AS w FROM
  (SELECT respondent, i, exp(avg(ln(a))) AS g FROM matrix GROUP BY 1, 2)),
sets AS (SELECT respondent, 'baseline' AS scenario, i, name, w AS weight FROM base UNION ALL
  SELECT b.respondent, k.name || s.tag, b.i, b.name, CASE WHEN b.i = k.i THEN k.w * (1 + s.d) ELSE b.w / (t.total - k.w) * (1 - k.w * (1 + s.d)) END
  FROM base b JOIN base k ON b.respondent = k.respondent JOIN (SELECT respondent, sum(w) AS total FROM base GROUP BY 1) t ON t.respondent = b.respondent,
  (VALUES ('_plus10', 0.1), ('_minus10', -0.1)) s(tag, d))"""


def _named(v):
    names = F.array(*[F.lit(n) for n in LABELS])
    return A.geometric_weights(_matrix(v)).withColumn("name", F.element_at(names, F.col("i") + 1))


@query("a07_perturbed_weights", sql("matrix", "SELECT respondent, scenario, i, name, round(weight, 6) AS weight FROM sets", _SETS))
def _(v):
    return A.perturbed(_named(v)).withColumn("weight", r6("weight"))


@query("a08_scenario_sets", sql("matrix", "SELECT scenario, count(DISTINCT respondent) AS respondents, round(sum(weight), 6) AS total FROM sets GROUP BY 1", _SETS))
def _(v):
    sets = A.perturbed(_named(v))
    return sets.groupBy("scenario").agg(F.countDistinct("respondent").alias("respondents"), r6(F.sum("weight")).alias("total"))


@query("a09_decode", sql("matrix", "SELECT respondent, i, j, round(a, 6) AS a FROM matrix"))
def _(v):
    return _matrix(v).withColumn("a", r6("a"))


@query("a10_aggregate", sql("matrix", "SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE exp(avg(ln(a))) END, 6) AS a FROM matrix GROUP BY 1, 2"))
def _(v):
    return A.aggregate_judgements(_matrix(v)).withColumn("a", r6("a"))


@query("a11_group_report", sql("matrix", """SELECT CAST(i - 1 AS INT) AS i, round(w[i], 6) AS weight, round((lambda_max - 5) / 4 / 1.12, 6) AS cr FROM gpower, range(1, 6) r(i)""",
  _POWER + """, used AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE exp(avg(ln(a))) END AS a FROM matrix SEMI JOIN (SELECT respondent FROM power WHERE (lambda_max - 5) / 4 / 1.12 <= 1.5) p USING (respondent) GROUP BY 1, 2),
  """ + _POWER.replace("flat AS", "gflat AS").replace("power AS", "gpower AS").replace("SELECT respondent, list(a ORDER BY i, j) AS m FROM matrix GROUP BY 1", "SELECT 0 AS respondent, list(a ORDER BY i, j) AS m FROM used").replace("FROM flat", "FROM gflat")))
def _(v):
    group, _report = A.group_solution(_matrix(v), max_cr=1.5)
    return A.weight_rows(group, keys=["cr"]).select("i", r6("weight").alias("weight"), r6("cr").alias("cr"))


@query("a11_respondents", sql("matrix", "SELECT respondent, round((lambda_max - 5) / 4 / 1.12, 6) AS cr, (lambda_max - 5) / 4 / 1.12 <= 1.5 AS accepted FROM power", _POWER))
def _(v):
    _group, report = A.group_solution(_matrix(v), max_cr=1.5)
    return report.withColumn("cr", r6("cr"))


# --- overlay -------------------------------------------------------------------------


@query("o01_criteria_stack", sql("layers", "SELECT cell_id, precip, ndvi_dry, soil, lst FROM layers"))
def _(v):
    return O.stack_layers(v.tall_layers, NAMES)


@query("o02_coverage", sql("layers", """SELECT count(*) AS cells, CAST(sum(CASE WHEN lst IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS valid_cells,
  round(avg(CASE WHEN lst IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM layers"""))
def _(v):
    return O.coverage(v.layers, NAMES).withColumn("coverage", r6("coverage"))


@query("o03_weighted_overlay", sql("risk", "SELECT cell_id, risk FROM risk"))
def _(v):
    return O.weighted_overlay(v.scores, WEIGHTS).select("cell_id", r9(F.col("risk")).alias("risk"))


_WATER = {"precip": 0.4, "soil": 0.3, "distance_to_water": 0.3}


def _watered(v):
    near = score_layers(v.distance.withColumnRenamed("distance_m", "distance_to_water"), [Criterion("distance_to_water", "minmax_capped", True, cap=150.0)])
    return v.scores.select("cell_id", "precip", "soil").join(near, "cell_id")


@query("o04_mitigation", sql("scores distance", """SELECT cell_id, round((0.4 * precip + 0.3 * soil + 0.3 * d) * (1 - 0.3 * (1 - d)), 6) AS mitigated, round(0.4 * precip + 0.3 * soil + 0.3 * d, 6) AS plain
  FROM scores JOIN (SELECT cell_id, least(distance_m / 150.0, 1) AS d FROM distance) USING (cell_id)"""))
def _(v):
    both = O.weighted_overlay(O.weighted_overlay(_watered(v), _WATER, output="mitigated"), _WATER, output="plain", mitigation=0.0)
    return both.select("cell_id", r6("mitigated").alias("mitigated"), r6("plain").alias("plain"))


@query("o05_risk_summary", sql("risk", """SELECT count(risk) AS n, round(min(risk), 6) AS "min", round(max(risk), 6) AS "max", round(avg(risk), 6) AS mean, round(median(risk), 6) AS median FROM risk"""))
def _(v):
    out = O.risk_summary(v.risk)
    return out.select("n", *[r6(c).alias(c) for c in ("min", "max", "mean", "median")])


@query("o06_contributions", sql("risk", "SELECT criterion, weight::DOUBLE AS weight, round(lo, 6) AS low, round(hi, 6) AS high, round(sp, 6) AS spread, round(sp / sum(sp) OVER (), 6) AS share FROM ("
  + " UNION ALL ".join(f"SELECT '{n}' AS criterion, {w} AS weight, min({n}) AS lo, max({n}) AS hi, stddev_pop({w} * {n}) AS sp FROM risk WHERE risk IS NOT NULL" for n, w in WEIGHTS.items()) + ")"))
def _(v):
    out = O.contributions(v.scores, WEIGHTS)
    return out.select("criterion", "weight", *[r6(c).alias(c) for c in ("low", "high", "spread", "share")])


def _scenarios() -> dict[str, dict[str, float]]:
    out = {}
    for name in NAMES:
        for tag, d in (("plus10", 0.1), ("minus10", -0.1)):
            new = WEIGHTS[name] * (1 + d)
            rest = sum(w for n, w in WEIGHTS.items() if n != name)
            out[f"{name}_{tag}"] = {n: new if n == name else w / rest * (1 - new) for n, w in WEIGHTS.items()}
    return out


_SENS = "sens AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS scenario, cell_id, class, risk AS base, round({w['precip']!r} * precip + {w['ndvi_dry']!r} * ndvi_dry + {w['soil']!r} * soil + {w['lst']!r} * lst, 9) AS r FROM classes WHERE risk IS NOT NULL"
    for s, w in _scenarios().items()
) + """), sranked AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY base) + (count(*) OVER (PARTITION BY scenario, base) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY scenario ORDER BY r) + (count(*) OVER (PARTITION BY scenario, r) - 1) / 2.0 AS ry FROM sens)"""


@query("o07_sensitivity", sql("classes rbreaks", """SELECT scenario, round(avg(abs(r - base)), 6) AS mean_abs_diff, round(max(abs(r - base)), 6) AS max_abs_diff,
  round(avg(CASE WHEN class = CASE WHEN r <= b1 THEN 1 WHEN r <= b2 THEN 2 WHEN r <= b3 THEN 3 WHEN r <= b4 THEN 4 ELSE 5 END THEN 1.0 ELSE 0.0 END), 6) AS class_agreement,
  round(corr(rx, ry), 6) AS spearman_rho FROM sranked, rbreaks GROUP BY 1""", _SENS))
def _(v):
    out = O.sensitivity(v.scores, WEIGHTS, _scenarios(), v.breaks)
    return out.select("scenario", *[r6(c).alias(c) for c in out.columns if c != "scenario"])


def _natural_sql(source: str) -> str:
    """Exact least squares within five classes: a dynamic program over all distinct values of each grid."""
    layer = """d{k} AS (SELECT grid, e, min(total) AS total, arg_min(cut, total) AS cut FROM (SELECT b.grid, b.i AS e, a.i AS cut, d.total + (b.cq - a.cq) - (b.cs - a.cs) ** 2 / (b.cn - a.cn) AS total
      FROM d{j} d JOIN cum a ON a.grid = d.grid AND a.i = d.e JOIN cum b ON b.grid = a.grid AND b.i > a.i {last}) GROUP BY 1, 2)"""
    return (
        f"""src AS ({source}), val AS (SELECT grid, risk AS v, count(*) AS n, avg(avg(risk)) OVER (PARTITION BY grid) AS m FROM src WHERE risk IS NOT NULL GROUP BY 1, 2),
    cum AS (SELECT grid, v, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(n * (v - m)) OVER w AS cs, sum(n * (v - m) ** 2) OVER w AS cq, count(*) OVER (PARTITION BY grid) AS last
      FROM val WINDOW w AS (PARTITION BY grid ORDER BY v ROWS UNBOUNDED PRECEDING)),
    d1 AS (SELECT grid, i AS e, cq - cs * cs / cn AS total FROM cum), """
        + ", ".join(layer.format(k=k, j=k - 1, last="AND b.i = b.last" if k == 5 else "") for k in range(2, 6))
        + """, ends AS (SELECT d5.grid, d2.cut AS e1, d3.cut AS e2, d4.cut AS e3, d5.cut AS e4, d5.e AS e5 FROM d5 JOIN d4 ON d4.grid = d5.grid AND d4.e = d5.cut
      JOIN d3 ON d3.grid = d5.grid AND d3.e = d4.cut JOIN d2 ON d2.grid = d5.grid AND d2.e = d3.cut),
    bounds5 AS (SELECT grid, k AS class, v AS upper FROM (SELECT grid, unnest([e1, e2, e3, e4, e5]) AS e, unnest([1, 2, 3, 4, 5]) AS k FROM ends) JOIN cum USING (grid) WHERE i = e),
    placed AS (SELECT grid, risk, coalesce((SELECT min(class) FROM bounds5 n WHERE n.grid = src.grid AND src.risk <= n.upper), 0) AS class FROM src)"""
    )


_NATURAL = "SELECT {grid} CAST(class AS INT) AS class, count(*) AS cells, max(risk) AS upper, round(var_pop(risk), 9) AS variance FROM placed GROUP BY {grid} class"


@query("o08_natural_breaks", sql("risk", _NATURAL.format(grid=""), _natural_sql("SELECT 0 AS grid, risk FROM risk")))
def _(v):
    breaks = K.compute_breaks(v.risk, "risk", method="jenks")
    return v.risk.groupBy(K.apply_breaks(F.col("risk"), breaks).alias("class")).agg(
        F.count("*").alias("cells"), F.max("risk").alias("upper"), r9(F.var_pop("risk")).alias("variance")
    )


@query("o08_natural_breaks_by_grid", sql("grisk", _NATURAL.format(grid="grid,"), _natural_sql("SELECT grid, risk FROM grisk")))
def _(v):
    classes, _rejected = G.classified_by(v.grid_risk, "risk", ["grid"], method="jenks")
    return classes.groupBy("grid", "class").agg(F.count("*").alias("cells"), F.max("risk").alias("upper"), r9(F.var_pop("risk")).alias("variance"))


@query("o05_risk_summary_by_grid", sql("grisk", """SELECT grid, count(risk) AS n, round(min(risk), 6) AS "min", round(max(risk), 6) AS "max", round(avg(risk), 6) AS mean, round(median(risk), 6) AS median FROM grisk GROUP BY 1"""))
def _(v):
    out = G.risk_summary_by(v.grid_risk, ["grid"])
    return out.select("grid", "n", *[r6(c).alias(c) for c in ("min", "max", "mean", "median")])


@query("o06_contributions_by_grid", sql("grisk", "SELECT grid, criterion, weight::DOUBLE AS weight, round(lo, 6) AS low, round(hi, 6) AS high, round(sp, 6) AS spread, round(sp / sum(sp) OVER (PARTITION BY grid), 6) AS share FROM ("
  + " UNION ALL ".join(f"SELECT grid, '{n}' AS criterion, {w} AS weight, min({n}) AS lo, max({n}) AS hi, stddev_pop({w} * {n}) AS sp FROM grisk WHERE risk IS NOT NULL GROUP BY grid" for n, w in WEIGHTS.items()) + ")"))
def _(v):
    out = G.contributions_by(v.grid_risk, WEIGHTS, ["grid"])
    return out.select("grid", "criterion", "weight", *[r6(c).alias(c) for c in ("low", "high", "spread", "share")])


@query("o09_equal_interval_by_grid", sql("grisk", """SELECT grid, CASE WHEN risk IS NULL THEN 0 WHEN risk <= lo + w THEN 1 WHEN risk <= lo + 2 * w THEN 2 WHEN risk <= lo + 3 * w THEN 3 WHEN risk <= lo + 4 * w THEN 4 ELSE 5 END AS class,
  count(*) AS cells FROM grisk JOIN (SELECT grid, min(risk) AS lo, (max(risk) - min(risk)) / 5 AS w FROM grisk GROUP BY 1) USING (grid) GROUP BY 1, 2"""))
def _(v):
    classes, _rejected = G.classified_by(v.grid_risk, "risk", ["grid"], method="equal_interval")
    return classes.groupBy("grid", "class").agg(F.count("*").alias("cells"))


_GBREAKS = "gbreaks AS (SELECT grid, " + ", ".join(f"quantile_cont(risk, {q}) AS b{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8, 1.0), 1)) + " FROM grisk GROUP BY grid)"


@query("o10_quantile_breaks_by_grid", sql("grisk", "SELECT grid, CAST(k AS INT) AS class, round([b1, b2, b3, b4, b5][k], 6) AS upper FROM gbreaks, range(1, 6) r(k)", _GBREAKS))
def _(v):
    breaks = G.breaks_by(v.grid_risk, "risk", ["grid"], method="quantile")
    return breaks.select("grid", F.posexplode("breaks").alias("class", "upper")).select("grid", (F.col("class") + 1).alias("class"), r6("upper").alias("upper"))


@query("o12_class_summary_by_grid", sql("grisk", """SELECT grid, class, cells, round(CASE WHEN class IS NULL OR class > 0 THEN 100.0 * cells / valid END, 6) AS share_pct, round(cells * 0.0009::DOUBLE, 6) AS area_km2 FROM (
  SELECT grid, class, count(*) AS cells FROM gclasses GROUP BY 1, 2 UNION ALL SELECT grid, NULL, count(*) FILTER (class > 0) FROM gclasses GROUP BY 1)
  JOIN (SELECT grid, count(*) FILTER (class > 0) AS valid FROM gclasses GROUP BY 1) USING (grid)""",
  _GBREAKS + """, gclasses AS (SELECT grid, CASE WHEN risk IS NULL THEN 0 WHEN risk <= b1 THEN 1 WHEN risk <= b2 THEN 2 WHEN risk <= b3 THEN 3 WHEN risk <= b4 THEN 4 ELSE 5 END AS class FROM grisk JOIN gbreaks USING (grid))"""))
def _(v):
    classes, _rejected = G.classified_by(v.grid_risk, "risk", ["grid"], method="quantile")
    out = K.class_summary(classes, v.grid.cell_km2, keys=["grid"])
    return out.select("grid", "class", "cells", r6("share_pct").alias("share_pct"), r6("area_km2").alias("area_km2"))


@query("o09_equal_interval", sql("risk", """SELECT CASE WHEN risk IS NULL THEN 0 WHEN risk <= lo + w THEN 1 WHEN risk <= lo + 2 * w THEN 2 WHEN risk <= lo + 3 * w THEN 3 WHEN risk <= lo + 4 * w THEN 4 ELSE 5 END AS class,
  count(*) AS cells FROM risk, (SELECT min(risk) AS lo, (max(risk) - min(risk)) / 5 AS w FROM risk) GROUP BY 1"""))
def _(v):
    breaks = K.compute_breaks(v.risk, "risk", method="equal_interval")
    return v.risk.groupBy(K.apply_breaks(F.col("risk"), breaks).alias("class")).agg(F.count("*").alias("cells"))


@query("o10_quantile_breaks", sql("rbreaks", "SELECT CAST(k AS INT) AS class, round([b1, b2, b3, b4, b5][k], 6) AS upper FROM rbreaks, range(1, 6) r(k)"))
def _(v):
    breaks = K.compute_breaks(v.risk, "risk", method="quantile")
    rows = F.array(*[F.struct(F.lit(i).alias("class"), F.lit(b).alias("upper")) for i, b in enumerate(breaks, 1)])
    # the class bounds, each with the cells that carry the class
    return v.classes.where("class > 0").select("class").distinct().join(
        v.spark.range(1).select(F.inline(rows)), "class"
    ).withColumn("upper", r6("upper"))


@query("o11_apply_breaks", sql("classes", "SELECT cell_id, class FROM classes"))
def _(v):
    return v.classes.select("cell_id", "class")


@query("o12_class_summary", sql("classes", """SELECT class, cells, round(CASE WHEN class IS NULL OR class > 0 THEN 100.0 * cells / valid END, 6) AS share_pct, round(cells * 0.0009::DOUBLE, 6) AS area_km2 FROM (
  SELECT class, count(*) AS cells FROM classes GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM classes WHERE class > 0), (SELECT count(*) AS valid FROM classes WHERE class > 0)"""))
def _(v):
    out = K.class_summary(v.classes.select("class"), v.grid.cell_km2)
    return out.select("class", "cells", r6("share_pct").alias("share_pct"), r6("area_km2").alias("area_km2"))


@query("o13_kmeans_crosscheck")
def _(v):
    return K.kmeans_agreement(v.risk, "risk", K.compute_breaks(v.risk, "risk", method="jenks"))


_W = WEIGHTS
_PAIR = f"""pair AS (SELECT a.cell_id, a.risk AS ra, round({_W['precip']} * a.precip + {_W['ndvi_dry']} * a.ndvi_dry + {_W['soil']} * (1 - a.soil) + {_W['lst']} * a.lst, 9) AS rb, a.class AS ca FROM classes a),
pb AS (SELECT round(quantile_cont(rb, 0.2), 9) AS q1, round(quantile_cont(rb, 0.4), 9) AS q2, round(quantile_cont(rb, 0.6), 9) AS q3, round(quantile_cont(rb, 0.8), 9) AS q4 FROM pair)"""


@query("o14_scenario_agreement", sql("classes", """SELECT count(*) AS n, round(avg(abs(ra - rb)), 6) AS mean_abs_diff, round(max(abs(ra - rb)), 6) AS max_abs_diff,
  round(avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END), 6) AS class_agreement, round(avg(CASE WHEN abs(ca - cb) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one_class FROM (
  SELECT *, CASE WHEN rb <= q1 THEN 1 WHEN rb <= q2 THEN 2 WHEN rb <= q3 THEN 3 WHEN rb <= q4 THEN 4 ELSE 5 END AS cb FROM pair, pb WHERE ra IS NOT NULL AND rb IS NOT NULL)""", _PAIR))
def _(v):
    flipped = O.weighted_overlay(v.scores.withColumn("soil", 1 - F.col("soil")), WEIGHTS, output="rb").select("cell_id", r9(F.col("rb")).alias("rb"))
    breaks = [round(b, 9) for b in K.compute_breaks(flipped, "rb", method="quantile")]
    pair = v.classes.select("cell_id", F.col("risk").alias("ra"), F.col("class").alias("ca")).join(
        flipped.withColumn("cb", K.apply_breaks(F.col("rb"), breaks)), "cell_id"
    )
    out = O.agreement(pair, "ra", "rb", "ca", "cb")
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query("o15_risk_histogram", sql("risk rbreaks", """SELECT bin, round(c, 6) AS centre, n, CASE WHEN c <= b1 THEN 1 WHEN c <= b2 THEN 2 WHEN c <= b3 THEN 3 WHEN c <= b4 THEN 4 ELSE 5 END AS class FROM (
  SELECT bin, any_value(lo + (bin + 0.5) * w) AS c, count(*) AS n FROM (SELECT CAST(least(floor((risk - lo) / w), 119) AS INT) AS bin, lo, w FROM risk, (SELECT min(risk) AS lo, (max(risk) - min(risk)) / 120 AS w FROM risk) WHERE risk IS NOT NULL) GROUP BY 1), rbreaks"""))
def _(v):
    return K.risk_histogram(v.risk, "risk", v.breaks).withColumn("centre", r6("centre"))


_SWAP = {"precip": 0.5, "ndvi_dry": 0.5}


@query("o16_layer_swap", sql("layers", """SELECT round(min(ndvi_dry), 6) AS ndvi_min, round(max(soil), 6) AS evi_max, round(median(ndvi_dry), 6) AS ndvi_median, round(avg(soil), 6) AS evi_mean, round(stddev_pop(ndvi_dry), 6) AS ndvi_std,
  round(corr(ndvi_dry, soil), 6) AS pearson, (SELECT round(corr(rx, ry), 6) FROM swapped) AS spearman, (SELECT round(corr(rx, rz), 6) FROM swapped) AS rho_ndvi, (SELECT round(corr(ry, rz), 6) FROM swapped) AS rho_evi,
  (SELECT CASE WHEN abs(corr(rx, rz)) >= abs(corr(ry, rz)) THEN 'ndvi' ELSE 'evi' END FROM swapped) AS better FROM layers""",
  """swapped AS (SELECT rank() OVER (ORDER BY ndvi_dry) + (count(*) OVER (PARTITION BY ndvi_dry) - 1) / 2.0 AS rx, rank() OVER (ORDER BY soil) + (count(*) OVER (PARTITION BY soil) - 1) / 2.0 AS ry,
  rank() OVER (ORDER BY precip) + (count(*) OVER (PARTITION BY precip) - 1) / 2.0 AS rz FROM layers)"""))
def _(v):
    from aridscape.plans.layer_swap import compare_layers

    out = compare_layers(v.layers, "ndvi_dry", "soil", "precip", names=("ndvi", "evi"))
    keep = ["ndvi_min", "evi_max", "ndvi_median", "evi_mean", "ndvi_std", "pearson", "spearman", "rho_ndvi", "rho_evi"]
    return out.select(*[r6(c).alias(c) for c in keep], "better")


@query("o16_swap_maps", sql("scores", """SELECT round(avg(abs(a - b)), 6) AS mean_abs_diff, round(max(abs(a - b)), 6) AS max_abs_diff, count(*) AS n,
  round(avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END), 6) AS same_class FROM (
  SELECT *, CASE WHEN a <= 0.2 THEN 1 WHEN a <= 0.4 THEN 2 WHEN a <= 0.6 THEN 3 WHEN a <= 0.8 THEN 4 ELSE 5 END AS ca,
            CASE WHEN b <= 0.2 THEN 1 WHEN b <= 0.4 THEN 2 WHEN b <= 0.6 THEN 3 WHEN b <= 0.8 THEN 4 ELSE 5 END AS cb
  FROM (SELECT round(0.6 * precip + 0.4 * ndvi_dry, 9) AS a, round(0.6 * precip + 0.4 * soil, 9) AS b FROM scores) WHERE a IS NOT NULL AND b IS NOT NULL)"""))
def _(v):
    base = {"precip": 0.6, "vegetation": 0.4}
    both = O.weighted_overlay(v.scores.withColumn("vegetation", F.col("ndvi_dry")), base, output="a")
    both = O.weighted_overlay(both.withColumn("vegetation", F.col("soil")), base, output="b")
    both = both.withColumns({"a": r9(F.col("a")), "b": r9(F.col("b"))}).where("a IS NOT NULL AND b IS NOT NULL")
    breaks = [0.2, 0.4, 0.6, 0.8, 1.0]
    classed = both.withColumns({"ca": K.apply_breaks(F.col("a"), breaks), "cb": K.apply_breaks(F.col("b"), breaks)})
    out = O.agreement(classed, "a", "b", "ca", "cb")
    return out.select("n", r6("mean_abs_diff").alias("mean_abs_diff"), r6("max_abs_diff").alias("max_abs_diff"), r6("class_agreement").alias("same_class"))


@query("o17_criterion_drop", sql("scores", f"""SELECT cell_id, round(({_W['precip']} * precip + {_W['ndvi_dry']} * ndvi_dry) / ({_W['precip']} + {_W['ndvi_dry']}) + 0 * soil + 0 * lst, 6) AS risk FROM scores"""))
def _(v):
    kept = O.dropped_weights(WEIGHTS, ["soil", "lst"])
    return O.weighted_overlay(v.scores, kept).select("cell_id", r6("risk").alias("risk"))


@query("o17_layer_spread", sql("scores", " UNION ALL ".join(f"SELECT '{n}' AS criterion, round(stddev_pop({n}), 6) AS std FROM scores WHERE lst IS NOT NULL" for n in NAMES)))
def _(v):
    return O.layer_spread(v.scores, NAMES).withColumn("std", r6("std"))


@query("o18_model_risk", sql("risk", """SELECT cell_id, round(least(greatest((-risk - lo) / (hi - lo + 1e-9), 0), 1), 6) + 0.0 AS model_risk FROM (SELECT cell_id, risk FROM risk WHERE risk IS NOT NULL),
  (SELECT min(-risk) AS lo, max(-risk) AS hi FROM risk)"""))
def _(v):
    predicted = v.risk.where("risk IS NOT NULL").select("cell_id", F.col("risk").alias("prediction"))
    return O.prediction_risk(predicted, output="model_risk").select("cell_id", r6("model_risk").alias("model_risk"))


@query("o17_drop_verdict", sql("joined scores labels", f"""SELECT round(max(r) FILTER (variant = 'full'), 6) AS full_rho, round(max(r) FILTER (variant = 'reduced'), 6) AS reduced_rho, CASE WHEN max(r) FILTER (variant = 'reduced') <= -0.1 THEN 'supported'
  WHEN max(r) FILTER (variant = 'reduced') < max(r) FILTER (variant = 'full') THEN 'rejected_still_weak' ELSE 'rejected_weaker' END AS verdict FROM (
  SELECT variant, avg(rho) AS r FROM (SELECT variant, "year", corr(rx, ry) AS rho FROM vranked GROUP BY 1, 2) JOIN labels USING ("year") WHERE is_dry GROUP BY 1)""",
  f"""variants AS (SELECT 'full' AS variant, cell_id, "year", anomaly, risk AS r FROM joined WHERE risk IS NOT NULL AND anomaly IS NOT NULL UNION ALL
  SELECT 'reduced', cell_id, "year", anomaly, round(({_W['precip']} * s.precip + {_W['ndvi_dry']} * s.ndvi_dry) / ({_W['precip']} + {_W['ndvi_dry']}), 9) FROM joined JOIN scores s USING (cell_id) WHERE joined.risk IS NOT NULL AND anomaly IS NOT NULL),
  vranked AS (SELECT *, rank() OVER (PARTITION BY variant, "year" ORDER BY r) + (count(*) OVER (PARTITION BY variant, "year", r) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY variant, "year" ORDER BY anomaly) + (count(*) OVER (PARTITION BY variant, "year", anomaly) - 1) / 2.0 AS ry FROM variants)"""))
def _(v):
    from aridscape.plans.historical_test import criterion_drop_test

    out = criterion_drop_test(v.scores, WEIGHTS, ["soil", "lst"], v.anomalies.select("cell_id", "year", "anomaly"), v.labels)
    return out.select(r6("full_rho").alias("full_rho"), r6("reduced_rho").alias("reduced_rho"), "verdict")
