"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted by k-means with a penalty on large clusters, on a sample of
at most ``SAMPLE`` vectors (in the order of a hash); every vector is indexed. A
vector near a boundary stands in several lists: in those whose centroid is at most
``spread`` times as far as the nearest one, ``replicas`` at most. Centroids are
found by a range search over an in-memory neighbour graph, which goes on from
every centroid within the ratio. A query reads the lists whose centroid is at most
``ratio`` times as far as the nearest (distance-ratio pruning) and ranks their
vectors exactly. Inner products are turned into distances by one more coordinate
that brings all vectors to the same norm.

Equal vectors are one entry that keeps its k + 1 smallest ids: no query needs
more of them. Lists are split into parts of ``PART`` entries, so neither a frequent
vector nor a full list meets in one task. Only the sample and the centroids
(``MAX_LISTS`` at most) pass through the driver and are sent to the tasks.

Defined results: rows without id, and vectors that are null, zero, of another
length than most, or hold null or non-finite components take no part; rows of one
id count as one vector each, and none of them answers a query of that id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.llm.common import written

SAMPLE = 20_000
MAX_LISTS = 16_384
PART = 16_384
DEGREE = 16


def valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return rows.where(F.size("v") == (usual["s"] if usual else -1))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``rep, v, ids``: each vector once, named by its smallest id, with its ``keep`` smallest ids."""
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h"))
    order = Window.partitionBy("h", "v").orderBy("id")
    few = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return few.groupBy("h", "v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).select("h", "rep", "v", "ids")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means in which a cluster's size is added to its distances."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner, scale = np.empty(len(x), np.int64), 0.0
        for at in range(0, len(x), 2048):
            d = squared_distances(x[at : at + 2048], centroids)
            scale += d.min(1).sum()
            owner[at : at + 2048] = (d + penalty).argmin(1)
        size = np.bincount(owner, minlength=k)
        penalty += 0.02 * scale / len(x) * (size * k / len(x) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        filled = size > 0
        centroids[filled] = sums[filled] / size[filled, None]
    return centroids


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Nearest centroids of each, and one further on a ring, which keeps the graph in one piece."""
    k = len(centroids)
    degree = min(degree, k - 1)
    near = np.empty((k, degree), np.int64)
    for at in range(0, k, 1024):
        d = squared_distances(centroids[at : at + 1024], centroids)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near[at : at + 1024] = np.argsort(d, axis=1)[:, :degree]
    return np.concatenate([near, (np.arange(k)[:, None] + 1) % k], axis=1)


def range_search(q: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float) -> np.ndarray:
    """Squared distances (queries x centroids), infinite where the search did not come.

    Starts at every 64th centroid and goes on from each one within ``ratio`` times
    the least distance seen, until no such centroid is left.
    """
    found = np.full((len(q), len(centroids)), np.inf)
    tried = np.zeros(found.shape, bool)
    starts = np.arange(0, len(centroids), 64)
    found[:, starts] = squared_distances(q, centroids[starts])
    while True:
        # the least one is always within the ratio
        open_ = ~tried & (found <= ratio * ratio * found.min(1, keepdims=True) + 1e-12)
        row, at = np.nonzero(open_)
        if not len(row):
            return found
        tried |= open_
        reach = np.zeros(found.shape, bool)
        reach[np.repeat(row, graph.shape[1]), graph[at].ravel()] = True
        row, at = np.nonzero(reach & np.isinf(found))
        for lo in range(0, len(row), 1 << 16):
            r, c = row[lo : lo + (1 << 16)], at[lo : lo + (1 << 16)]
            gap = q[r] - centroids[c]
            found[r, c] = np.einsum("ij,ij->i", gap, gap)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _placed(rows: DataFrame, model: tuple, ratio: float, most: int, lift: float | None) -> DataFrame:
    """``rep, v, list``: each vector with the lists within the ratio, ``most`` at most (0: all)."""
    centroids, graph = model

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                v = _matrix(part.column(1))
                more = np.sqrt(np.maximum(lift * lift - (v * v).sum(1), 0))[:, None] if lift is not None else np.zeros((len(v), 1))
                d = range_search(np.concatenate([v, more], axis=1), centroids, graph, ratio)
                near = d <= ratio * ratio * d.min(1, keepdims=True) + 1e-12
                if most and most < d.shape[1]:
                    near &= d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most]
                row, at = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at.astype(np.int32))], ["rep", "v", "list"])

    return rows.select("rep", "v").mapInArrow(run, "rep long, v array<double>, list int")


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def nearest(
    df: DataFrame,
    id_column: str,
    vector: str,
    is_query: Column,
    k: int = 20,
    ratio: float = 1.08,
    spread: float = 1.08,
    replicas: int = 3,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors with the largest inner
    products found for every row with ``is_query`` (an expression over ``id``)."""
    rows = valid(df, id_column, vector)
    entries = written(distinct_vectors(rows, k + 1), "vectors")
    size = entries.count()
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lift = math.sqrt(entries.agg(F.max(squared)).first()[0] or 1.0)
    sample = entries.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample]) if sample else np.zeros((1, 1))
    x = np.concatenate([x, np.sqrt(np.maximum(lift * lift - (x * x).sum(1), 0))[:, None]], axis=1)
    lists = max(1, min(MAX_LISTS, len(x) // 8, math.ceil(math.sqrt(size) / 8)))
    centroids = balanced_centroids(x, lists)
    model = (centroids, neighbour_graph(centroids))

    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("h"), "v").distinct()
    queries = written(queries.join(entries.select("h", "v", "rep"), ["h", "v"]).select("query_id", "rep"), "queries")
    asked = entries.join(queries.select("rep").distinct(), "rep", "left_semi")
    postings = written(_placed(entries, model, spread, replicas, lift), "postings")
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    held = postings.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("list", "part", "rep", "v")
    probes = _placed(asked, model, ratio, 0, None).join(parts, "list")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "rep", "v")

    def score(asking: pa.Table, entry: pa.Table) -> pa.Table:
        q, c = _matrix(asking.column("v")), _matrix(entry.column("v"))
        rep, out = entry.column("rep").to_numpy(), []
        if not len(c):
            q = q[:0]
        name = asking.column("rep").to_numpy()
        for lo in range(0, len(q), 256):
            products = q[lo : lo + 256] @ c.T
            n = min(k + 1, len(c))
            # by value, then by the smaller id: what ties with the last one stays in
            last = np.partition(products, len(c) - n, axis=1)[:, len(c) - n]
            i, j = np.nonzero(products >= last[:, None] - 1e-9)
            out.append((name[lo + i], rep[j], exact_products(q[lo + i], c[j])))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"asked": columns[0], "rep": columns[1], "score": columns[2]})

    found = probes.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInArrow(score, "asked long, rep long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    top = found.groupBy("asked", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = written(top.join(entries.select("rep", "ids"), "rep").select("asked", "score", "ids"), "top")
    answers = queries.join(named, queries.rep == named.asked).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
