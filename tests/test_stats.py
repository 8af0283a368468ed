import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import stats
from aridscape.operators.stats import Marks, column_quantiles, hash_sample, spearman, with_rank


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows carry one value in x, another third one in y."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "x": np.round(rng.lognormal(3, 1.5, n), 3), "y": np.round(rng.normal(size=n), 3)})
    pdf.loc[: n // 3, "x"] = 5.0
    pdf.loc[n // 2 : n // 2 + n // 3, "y"] = 0.25
    pdf.loc[5000:5100, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df.cache()


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.02, 0.333, 0.5, 0.98, 1.0]
    got = column_quantiles(df, ["x", "y"], probs)
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c], np.percentile(pdf[c].dropna(), np.array(probs) * 100), rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.range(5).withColumn("v", F.lit(None).cast("double"))
    assert np.isnan(column_quantiles(df, ["v"], [0.5])["v"][0])
    assert np.isnan(column_quantiles(df, ["v", "id"], [0.5])["v"][0])


@pytest.mark.parametrize("buckets", [2, 40, 3000])
def test_spearman_equals_pandas_at_any_bucket_count(skewed, buckets):
    pdf, df = skewed
    got = {r["g"]: r for r in spearman(df, "x", "y", groups=["g"], buckets=buckets).collect()}
    for g, part in pdf.dropna().groupby("g"):
        expected = part["x"].rank().corr(part["y"].rank())
        assert abs(got[g]["rho"] - expected) < 1e-10
        assert got[g]["n"] == len(part)


def test_frequent_values_need_no_order(skewed):
    """A value that fills a bucket alone is dealt out over tasks."""
    pdf, df = skewed
    marks, _ = Marks.measure(df.where("x IS NOT NULL"), ["x", "y"], 20)
    assert len(marks.single) == 1
    rows = df.where("x IS NOT NULL")
    ranked = with_rank(rows, "x", ["g"], marks, rows, "y", "rank").toPandas()
    expected = ranked.groupby("g")["x"].rank()
    np.testing.assert_allclose(ranked["rank"], expected)


def test_null_groups_are_a_group(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, float(i), float(i * i)) for i in range(40)], "g int, x double, y double")
    assert {r["g"]: r["n"] for r in spearman(df, "x", "y", groups=["g"], min_n=2).collect()} == {None: 20, 1: 20}


def test_quantiles_beyond_what_is_read(skewed, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 0)
    pdf, df = skewed
    got = column_quantiles(df, ["x", "y"], [0.1, 0.9])
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c], np.percentile(pdf[c].dropna(), [10, 90]), rtol=1e-12)


def test_spearman_gates(spark):
    few = spark.createDataFrame([(float(i), float(-i)) for i in range(50)], "x double, y double")
    assert spearman(few, "x", "y").first()["rho"] is None
    assert spearman(few, "x", "y", min_n=2).first()["rho"] == pytest.approx(-1)
    flat = few.withColumn("y", F.lit(1.0))
    assert spearman(flat, "x", "y", min_n=2).first()["rho"] is None


def test_hash_sample_is_exact_and_reproducible(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 7 == 0).cast("int"))
    first = hash_sample(df, ["g"], 300, ["id"], seed=1)
    counts = {r["g"]: r["count"] for r in first.groupBy("g").count().collect()}
    assert counts == {0: 300, 1: 300}
    again = hash_sample(df.repartition(7), ["g"], 300, ["id"], seed=1)
    assert first.select("id").exceptAll(again.select("id")).count() == 0
    assert first.select("id").intersect(hash_sample(df, ["g"], 300, ["id"], seed=2).select("id")).count() < 300
    # smaller groups come back whole
    assert hash_sample(df, ["g"], 10**6, ["id"]).count() == 5000
    # the kept rows are those with the smallest hash, read as unsigned
    pdf = df.withColumn("h", F.xxhash64("id", F.lit(1))).toPandas()
    pdf["h"] = pdf["h"].to_numpy().view("uint64")
    expected = pdf.sort_values("h").groupby("g").head(300)["id"]
    assert set(expected) == {r["id"] for r in first.collect()}


def test_tiny_magnitudes_keep_their_ranks(spark):
    df = spark.createDataFrame([(i * 1e-12, float(i * i)) for i in range(1, 200)], "x double, y double")
    assert spearman(df, "x", "y").first()["rho"] == pytest.approx(1)
