"""Quantiles, scores and classes of many groups at once against numpy per group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import classify, keyed, normalize, overlay


@pytest.fixture(scope="module")
def grids(spark):
    """Four grids: a large skewed one, a small one, one of few values, one without values; null is a key too."""
    rng = np.random.default_rng(8)
    parts = [
        pd.DataFrame({"grid": "a", "v": np.round(rng.lognormal(1, 2, 6000), 4), "w": rng.normal(size=6000)}),
        pd.DataFrame({"grid": "b", "v": rng.normal(size=70), "w": np.repeat([1.0, 2.0], 35)}),
        pd.DataFrame({"grid": None, "v": rng.integers(0, 9, 300).astype(float), "w": rng.normal(size=300)}),
        pd.DataFrame({"grid": "flat", "v": np.full(40, 7.0), "w": np.full(40, np.nan)}),
    ]
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[10:500, "v"] = 2.5
    pdf.loc[5:9, "v"] = np.nan
    pdf["cell_id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "w")})
    df = df.withColumn("grid", F.when(F.col("grid") != "NaN", F.col("grid")))
    return pdf, df.cache()


@pytest.mark.parametrize("few", [0, 50, 4096])
def test_quantiles_of_every_group(grids, few, monkeypatch):
    monkeypatch.setattr(keyed, "FEW", few)
    pdf, df = grids
    probs = [0.0, 0.02, 0.5, 0.777, 1.0]
    got = {r["grid"]: r for r in keyed.keyed_quantiles(df, ["v", "w"], probs, ["grid"]).collect()}
    for grid, part in pdf.groupby("grid", dropna=False):
        row = got[None if pd.isna(grid) else grid]
        for c in ("v", "w"):
            values = part[c].dropna()
            assert row[c]["n"] == len(values)
            if len(values):
                np.testing.assert_allclose(row[c]["q"], np.percentile(values, np.array(probs) * 100), rtol=1e-12)
            else:
                assert row[c]["q"] is None


def test_one_bad_grid_leaves_the_others(grids):
    pdf, df = grids
    spec = [normalize.Criterion("v", "minmax_percentile", False)]
    scores, rejected = keyed.score_layers_by(df, spec, ["grid"])
    assert [(r["grid"], r["reason"]) for r in rejected.collect()] == [("flat", "v: constant layer")]
    got = scores.toPandas()
    for grid, part in pdf.groupby("grid", dropna=False):
        if grid == "flat":
            continue
        low, high = np.percentile(part["v"].dropna(), [2, 98])
        mine = got[got["cell_id"].isin(part["cell_id"])].set_index("cell_id")["v"].reindex(part["cell_id"])
        np.testing.assert_allclose(mine, 1 - np.clip((part["v"] - low) / (high - low), 0, 1).to_numpy(), atol=1e-12)


@pytest.mark.parametrize("method", classify.METHODS)
def test_breaks_equal_those_of_each_grid_alone(grids, method):
    _, df = grids
    got = {r["grid"]: r for r in keyed.breaks_by(df, "v", ["grid"], method=method, bars=16).collect()}
    assert got["flat"]["breaks"] is None and got["flat"]["reason"] == "only 1 distinct values for 5 classes"
    for grid in ("a", "b", None):
        alone = classify.compute_breaks(df.where(F.col("grid").eqNullSafe(grid)), "v", method=method)
        assert got[grid]["breaks"] == pytest.approx(alone)
    classes, rejected = keyed.classified_by(df, "v", ["grid"], method=method, bars=16)
    assert [r["grid"] for r in rejected.collect()] == ["flat"]
    one = classes.where("grid = 'a'").select("class", classify.apply_breaks(F.col("v"), got["a"]["breaks"]).alias("plain"))
    assert one.where("class <> plain").count() == 0


def test_summaries_by_grid(grids):
    pdf, df = grids
    got = {r["grid"]: r for r in keyed.risk_summary_by(df, ["grid"], "v").collect()}
    a = pdf[pdf["grid"] == "a"]["v"].dropna()
    assert got["a"]["median"] == pytest.approx(a.median()) and got["a"]["n"] == len(a)
    alone = {r["criterion"]: r["share"] for r in overlay.contributions(df.where("grid = 'b'"), {"v": 0.6, "w": 0.4}).collect()}
    shares = {r["criterion"]: r["share"] for r in keyed.contributions_by(df, {"v": 0.6, "w": 0.4}, ["grid"]).where("grid = 'b'").collect()}
    assert shares == pytest.approx(alone)
    layers = {(r["grid"], r["layer"]): r for r in keyed.profile_by(df, ["v", "w"], ["grid"]).collect()}
    assert layers["flat", "w"]["masked_share"] == 1.0 and layers["a", "v"]["median"] == pytest.approx(a.median())


def test_no_rows(grids):
    _, df = grids
    none = df.where("false")
    assert keyed.keyed_quantiles(none, ["v"], [0.5], ["grid"]).count() == 0
    assert keyed.breaks_by(none, "v", ["grid"]).count() == 0


def test_bar_of_counts_the_edges_up_to_a_value(spark):
    rng = np.random.default_rng(12)
    for size in (0, 1, 2, 3, 7, 8, 9, 300):
        edges = sorted(rng.normal(size=size).round(1).tolist())
        values = [-9.0, 9.0, 0.0, *rng.normal(size=20).tolist(), *edges[:40]]
        df = spark.createDataFrame([(v, edges) for v in values], "v double, e array<double>")
        got = [r[0] for r in df.select(keyed.bar_of(F.col("v"), F.col("e"))).collect()]
        assert got == np.searchsorted(edges, values, "right").tolist()
