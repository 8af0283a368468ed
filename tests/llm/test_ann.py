import numpy as np
from pyspark.sql import functions as F

from aridscape.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def clustered(n=600, dims=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = (centres[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dims))).astype(np.float32)
    return x * r.uniform(0.5, 2, (n, 1)).astype(np.float32)


def brute(x, ids, queries, k):
    out = {}
    y = x.astype(np.float64)
    for q in queries:
        s = [(-float(sum(a * b for a, b in zip(y[q], y[j]))), ids[j]) for j in range(len(y)) if ids[j] != ids[q]]
        out[ids[q]] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def test_recall_and_scores(spark):
    x = clustered()
    ids = list(range(600))
    got = {}
    for r in ann.nearest(table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), "vec_id", "embedding", F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(x, ids, range(0, 600, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        exact = dict(brute(x, ids, [q], 600)[q])
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 400, 10)] + [(7, [2.0, 0.0]), (9, [0.0, 1.0])]
    rows += [(5, None), (11, [0.0, 0.0]), (13, [None, 1.0]), (15, [float("nan"), 1.0]), (17, [float("inf"), 1.0]), (None, [1.0, 1.0]), (19, [1.0, 2.0, 3.0]), (21, [])]
    got = {}
    for r in ann.nearest(table(spark, rows), "vec_id", "embedding", F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        copies = [i for i in range(0, 400, 10) if i != q][:4]
        assert found == [(7, 2.0), *[(i, 1.0) for i in copies]]


def test_few_and_no_rows(spark):
    assert ann.nearest(table(spark, []), "vec_id", "embedding", F.lit(True)).count() == 0
    one = ann.nearest(table(spark, [(0, [1.0, 1.0]), (1, [2.0, 1.0])]), "vec_id", "embedding", F.lit(True)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in one} == {(0, 1, 1, 3.0), (1, 1, 0, 3.0)}


def test_range_search_finds_all_within_the_ratio():
    x = clustered(300, 8, 3).astype(float)
    centroids = ann.balanced_centroids(x, 40)
    found = ann.range_search(x, centroids, ann.neighbour_graph(centroids, 8), 1.2)
    d = ann.squared_distances(x, centroids)
    near = d <= 1.44 * d.min(1, keepdims=True)
    assert np.isfinite(found[near]).mean() > 0.97
    size = np.bincount(d.argmin(1), minlength=40)
    assert size.max() <= 6 * len(x) / 40
