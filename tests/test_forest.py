"""Forests over binned rows: plain recursion, draws, passes and stored models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aridscape.operators import forest as R
from aridscape.operators import ml as L

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({"cell_id": np.arange(n) // 4, "year": 2000 + np.arange(n) % 4, "a": rng.random(n), "b": rng.normal(size=n), "c": rng.integers(0, 6, n) / 7})
    pdf["label"] = np.sin(6 * pdf["a"]) + 0.3 * pdf["c"] + 0.1 * rng.normal(size=n)
    pdf["fold"] = (pdf["cell_id"] // 10 % 5).astype("int32")
    return spark.createDataFrame(pdf).cache()


def jobs_of(spark, run):
    context = spark.sparkContext
    context.setJobGroup(f"jobs-{id(run)}", "counted")
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup(f"jobs-{id(run)}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def plain(codes, n, w, y, sizes, depth, min_leaf):
    """Predictions of a tree grown by recursion over every split."""
    out = np.zeros(len(n))
    square = lambda m: (w[m] * y[m]).sum() ** 2 / w[m].sum()

    def grow(inside, level):
        best = (1e-9, None)
        for f in range(codes.shape[1]) if level < depth else ():
            for b in range(sizes[f] - 1):
                left = inside & (codes[:, f] <= b)
                right = inside & ~left
                if min(n[left].sum(), n[right].sum()) >= min_leaf:
                    gain = square(left) + square(right) - square(inside)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            out[inside] = (w[inside] * y[inside]).sum() / w[inside].sum()
        else:
            for side in best[1]:
                grow(side, level + 1)

    grow(np.ones(len(n), bool), 0)
    return out


def test_a_tree_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    sizes = [8, 1, 12]
    for _ in range(10):
        codes = np.stack([rng.integers(0, size, 250) for size in sizes], 1).astype(np.uint8)
        n = rng.poisson(1, 250) + 1.0
        w, y = n * rng.random(250), 0.3 * codes[:, 0] + rng.normal(size=250)
        tree = R.grow_tree(codes, n, w, w * y, sizes, depth=5, min_leaf=5)
        assert R.walk([tree], codes) == pytest.approx(plain(codes, n, w, y, sizes, 5, 5), abs=1e-9)
        assert tree[4].sum() == pytest.approx(1) and tree[4][1] == 0


def test_bins_hold_equal_numbers_of_all_rows(spark):
    rng = np.random.default_rng(5)
    values = np.exp(2 * rng.normal(size=40_000))
    told = [R.value_runs(part, 256) for part in np.array_split(values, 7)]
    edges = R.bin_edges(np.concatenate([v for v, _ in told]), np.concatenate([n for _, n in told]), 64)
    counts = np.bincount(np.searchsorted(edges, values))
    assert len(counts) == 64 and abs(counts - 625).max() <= 2 * 40_000 / 256
    assert R.bin_edges(np.array([1.0, 3.0, 1.0, 9.0]), np.array([5, 1, 2, 900]), 64).tolist() == [2.0, 6.0]
    points = spark.createDataFrame(pd.DataFrame({"x": values, "k": 1.0}))
    (edges, flat), rows = R.measure_bins(L.assemble(points, ["x", "k"]), 64)
    assert rows == 40_000 and len(edges) == 63 and not len(flat)


def test_draws_are_the_rows_own():
    key = np.random.default_rng(6).integers(0, 2**63, 100_000).astype(np.uint64)
    table = R.draw_table(1.0)
    first, second = (R.draw_rows(key, tree, 42, table) for tree in (0, 1))
    assert first.mean() == pytest.approx(1, abs=0.02) and first.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.02
    assert (R.draw_rows(key[::-1], 0, 42, table)[::-1] == first).all()
    assert R.draw_rows(key, 0, 42, R.draw_table(0.03)).mean() == pytest.approx(0.03, abs=0.005)


def test_folds_are_fitted_on_all_other_rows(table, monkeypatch):
    sample, fitted, fit = L.equal_sample, [], L.RandomForestRegressor.fit
    monkeypatch.setattr(L, "equal_sample", lambda rows, *a, **o: sample(rows, 100))
    monkeypatch.setattr(L.RandomForestRegressor, "fit", lambda self, df: (fitted.append(df.count()), fit(self, df))[1])
    scores, ranking = L.cross_validate(table, FEATURES, trees=5, depth=8)
    sizes = {r["fold"] + 1: r["count"] for r in table.groupBy("fold").count().collect()}
    assert sorted(fitted) == sorted(3000 - n for n in sizes.values())
    assert {r["fold"]: r["n"] for r in scores.collect()} == sizes
    assert scores.agg(F.min("r2")).first()[0] > 0.9 and ranking.first()["feature"] == "a"
    assert ranking.agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_a_fit_takes_few_passes_at_any_depth(spark, table):
    points = L.training_points(L.assemble(table, FEATURES))
    assert jobs_of(spark, lambda: L.forest(FEATURES, trees=3, depth=14).fit(points)) <= 6


def test_the_final_fit_takes_few_passes_at_any_depth(spark, table):
    assert jobs_of(spark, lambda: L.fit_final(L.year_weights(table), FEATURES, trees=3, depth=14)) <= 12


def test_the_final_trees_draw_as_many_rows_as_there_are(table, monkeypatch):
    monkeypatch.setattr(L, "tree_share", lambda rows, trees, size=50: size / rows)
    model = L.fit_final(table, FEATURES, trees=4, depth=15, min_leaf=1)
    # a tree over 50 rows has at most 99 nodes
    assert all(len(tree[0]) > 500 for tree in model.trees)
    assert all(len(tree[0]) < 150 for tree in L.fit_final(table, FEATURES, trees=4, depth=15, min_leaf=1, draw=50).trees)


def test_a_forest_does_not_depend_on_where_rows_lie(spark, table, tmp_path):
    model = L.fit_final(table, FEATURES, trees=3, depth=8, path=str(tmp_path))
    again = L.fit_final(table.repartition(7, "b"), FEATURES, trees=3, depth=8)
    rows = L.assemble(table, FEATURES)
    one, two = (m.transform(rows).select("cell_id", "year", "prediction").toPandas().sort_values(["cell_id", "year"])["prediction"].to_numpy() for m in (model, again))
    assert len(one) == 3000 and one == pytest.approx(two, abs=1e-12)
    pdf = table.toPandas().sort_values(["cell_id", "year"])
    assert one == pytest.approx(R.walk(model.trees, R.bin_codes(pdf[FEATURES].to_numpy(), model.edges)), abs=1e-12)
    assert L.stored_model(str(tmp_path)).uid == model.uid


def test_rows_of_equal_bins_share_a_group_whatever_the_width():
    codes = np.random.default_rng(8).integers(0, 2, (400, 11)).astype(np.uint8)
    codes[:, 2:9] = 0
    order, starts = R.group_rows(codes)
    groups = np.split(codes[order], starts[1:])
    assert len(groups) == len({g[0].tobytes() for g in groups}) == len({c.tobytes() for c in codes})
    assert all((g == g[0]).all() for g in groups)
