"""Pairwise-comparison weighting as a batch over many respondents.

Judgements are tall: ``respondent, i, j, a``; one matrix is one array. The random
index ends at ten criteria: larger matrices are solved too, but have no
consistency ratio and are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Random consistency index for n = 1..10.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)
MAX_CR = 0.10


class InconsistentMatrixError(ValueError):
    """A consistency ratio exceeds the accepted limit."""


def decode_answer(answer: Column) -> Column:
    """Signed scale: +k means k, -k means 1/k; outside 1..9 yields null."""
    size = F.abs(answer)
    return F.when(size.between(1, 9), F.when(answer > 0, answer.cast("double")).otherwise(F.lit(1.0) / size))


def full_matrix(upper: DataFrame, *, keys: Sequence[str] = ("respondent",)) -> DataFrame:
    """Upper-triangle judgements ``i < j`` -> all cells, reciprocals and diagonal added."""
    cells = F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("a").alias("a")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.lit(1.0) / F.col("a")).alias("a")),
    )
    off = upper.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    diagonal = off.select(*keys, "i").distinct().select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("a"))
    return off.unionByName(diagonal)


def matrix_violations(matrix: DataFrame, *, keys: Sequence[str] = ("respondent",), tolerance: float = 1e-3) -> DataFrame:
    """Rows ``keys, rule, i, j, value`` for every broken rule; empty means valid.

    The two halves of a pair meet in one aggregation on the unordered pair.
    """
    keys = list(keys)
    a, i, j = F.col("a"), F.col("i"), F.col("j")
    pair = matrix.groupBy(*keys, F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(
        F.count("*").alias("cells"),
        F.max(F.when(i < j, a)).alias("upper"),
        F.max(F.when(i > j, a)).alias("lower"),
        F.max(F.when(i == j, a)).alias("diag"),
        F.min(a).alias("least"),
        F.max(F.isnan(a) | a.isNull() | (F.abs(a) == F.lit(float("inf")))).alias("broken"),
    )
    product = F.col("upper") * F.col("lower")
    size = F.when(F.col("p") == F.col("q"), 1).otherwise(2)
    rules = F.array(
        F.when(F.col("broken"), F.struct(F.lit("not finite").alias("rule"), F.col("least").alias("value"))),
        F.when(F.col("least") <= 0, F.struct(F.lit("not positive").alias("rule"), F.col("least").alias("value"))),
        F.when(F.abs(F.col("diag") - 1) > tolerance, F.struct(F.lit("diagonal").alias("rule"), F.col("diag").alias("value"))),
        F.when(F.abs(product - 1) > 2 * tolerance, F.struct(F.lit("reciprocity").alias("rule"), product.alias("value"))),
        F.when(F.col("cells") != size, F.struct(F.lit("cell count").alias("rule"), F.col("cells").cast("double").alias("value"))),
    )
    per_pair = pair.select(
        *keys, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("v"), F.col("p").alias("i"), F.col("q").alias("j")
    ).select(*keys, "v.rule", "i", "j", "v.value")
    shape = (
        matrix.groupBy(*keys)
        .agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n"), F.count("*").alias("cells"))
        .where((F.col("n") < 2) | (F.col("cells") != F.col("n") * F.col("n")))
        .select(*keys, F.lit("shape").alias("rule"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.col("cells").cast("double").alias("value"))
    )
    return per_pair.unionByName(shape)


_EIGENPAIR = T.StructType([T.StructField("lambda_max", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_EIGENPAIR)
def _principal(flat: pd.Series) -> pd.DataFrame:
    """Principal eigenpair of row-major matrices; one batched solve per size."""
    sizes = flat.map(len).to_numpy()
    lambdas = np.full(len(flat), np.nan)
    weights: list = [None] * len(flat)
    for size in np.unique(sizes):
        n = int(round(size**0.5))
        if n * n != size or n < 2:
            continue
        rows = np.flatnonzero(sizes == size)
        stack = np.stack([np.asarray(flat.iloc[r], dtype="float64") for r in rows]).reshape(-1, n, n)
        values, vectors = np.linalg.eig(stack)
        top = np.argmax(values.real, axis=1)
        picked = np.abs(np.take_along_axis(vectors, top[:, None, None], axis=2)[:, :, 0].real)
        picked = picked / picked.sum(axis=1, keepdims=True)
        for k, r in enumerate(rows):
            lambdas[r], weights[r] = values[k, top[k]].real, picked[k].tolist()
    return pd.DataFrame({"lambda_max": lambdas, "weights": weights})


def consistency(lambda_max: Column, n: Column, random_index: Sequence[float] = RANDOM_INDEX) -> tuple[Column, Column, Column]:
    """(CI, RI, CR). Zero below three criteria; null where the index table ends."""
    table = F.array(*[F.lit(float(v)) for v in random_index])
    ri = F.when(n < 3, 0.0).otherwise(F.try_element_at(table, n.cast("int")))
    ci = F.when(n < 3, 0.0).otherwise((lambda_max - n) / (n - 1))
    return ci, ri, F.when(n < 3, 0.0).otherwise(F.try_divide(ci, ri))


def solve(matrix: DataFrame, *, keys: Sequence[str] = ("respondent",), max_cr: float = MAX_CR, random_index: Sequence[float] = RANDOM_INDEX) -> DataFrame:
    """Eigenvector weights, consistency and the accept flag per matrix."""
    merged = matrix.groupBy(*keys, "i", "j").agg(F.max("a").alias("a"))
    flat = merged.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "a"))), lambda s: s["a"]).alias("flat")
    )
    solved = flat.select(*keys, F.sqrt(F.size("flat")).cast("int").alias("n"), _principal("flat").alias("p"))
    ci, ri, cr = consistency(F.col("p.lambda_max"), F.col("n"), random_index)
    return solved.select(
        *keys,
        "n",
        F.col("p.lambda_max").alias("lambda_max"),
        F.col("p.weights").alias("weights"),
        ci.alias("ci"),
        ri.alias("ri"),
        cr.alias("cr"),
    ).withColumn("accepted", F.coalesce(F.col("cr") <= max_cr, F.lit(False)))


def require_consistent(solved: DataFrame) -> DataFrame:
    """API edge: raise when a matrix was rejected."""
    bad = solved.where(~F.coalesce("accepted", F.lit(False))).limit(5).collect()
    if bad:
        raise InconsistentMatrixError("; ".join(f"CR = {r['cr']}" for r in bad))
    return solved


def weight_rows(solved: DataFrame, *, keys: Sequence[str] = ("respondent",)) -> DataFrame:
    return solved.select(*keys, F.posexplode("weights").alias("i", "weight"))


def geometric_weights(matrix: DataFrame, *, keys: Sequence[str] = ("respondent",)) -> DataFrame:
    """Row geometric means scaled to sum one."""
    rows = matrix.groupBy(*keys, "i").agg(F.exp(F.avg(F.ln("a"))).alias("g"))
    total = F.sum("g").over(Window.partitionBy(*keys))
    return rows.select(*keys, "i", (F.col("g") / total).alias("weight"))


def method_gap(solved: DataFrame, geometric: DataFrame, *, keys: Sequence[str] = ("respondent",)) -> DataFrame:
    """Largest difference between eigenvector and geometric-mean weights."""
    pair = weight_rows(solved, keys=keys).join(geometric.withColumnRenamed("weight", "g"), [*keys, "i"])
    return pair.groupBy(*keys).agg(F.max(F.abs(F.col("weight") - F.col("g"))).alias("max_gap"))


def ranked(weights: DataFrame, *, keys: Sequence[str] = ("respondent",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "i")
    return weights.withColumn("position", F.row_number().over(order))


def perturbed(weights: DataFrame, perturbation: float = 0.10, *, keys: Sequence[str] = ("respondent",), renormalize: bool = True) -> DataFrame:
    """Baseline plus one up and one down scenario per criterion.

    ``weights`` has ``i, weight`` and an optional ``name``; the other weights
    keep their ratios and give or take the difference. Scenarios that would
    empty a weight or swallow all of them come out null, so callers can reject
    them.
    """
    named = weights if "name" in weights.columns else weights.withColumn("name", F.col("i").cast("string"))
    packed = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "name", "weight"))).alias("w"))
    tag = int(perturbation * 100)
    scenarios = F.concat(
        F.array(F.struct(F.lit("baseline").alias("scenario"), F.lit(None).cast("int").alias("k"), F.lit(0.0).alias("d"))),
        F.flatten(
            F.transform(
                "w",
                lambda c: F.array(
                    F.struct(F.concat(c["name"], F.lit(f"_plus{tag}")).alias("scenario"), c["i"].cast("int").alias("k"), F.lit(perturbation).alias("d")),
                    F.struct(F.concat(c["name"], F.lit(f"_minus{tag}")).alias("scenario"), c["i"].cast("int").alias("k"), F.lit(-perturbation).alias("d")),
                ),
            )
        ),
    )
    rows = packed.select(*keys, "w", F.explode(scenarios).alias("s")).select(
        *keys, F.col("s.scenario").alias("scenario"), F.col("s.k").alias("k"), F.col("s.d").alias("d"), F.explode("w").alias("c"),
        F.aggregate("w", F.lit(0.0), lambda acc, c: acc + F.when(c["i"] == F.col("s.k"), c["weight"]).otherwise(0.0)).alias("old"),
        F.aggregate("w", F.lit(0.0), lambda acc, c: acc + F.when(c["i"] == F.col("s.k"), 0.0).otherwise(c["weight"])).alias("rest"),
    )
    new = F.col("old") * (F.lit(1.0) + F.col("d"))
    other = F.col("c.weight") / F.col("rest") * (F.lit(1.0) - new) if renormalize else F.col("c.weight")
    invalid = (new <= 0) | ((new >= 1) if renormalize else F.lit(False))
    value = (
        F.when(F.col("k").isNull(), F.col("c.weight"))
        .when(invalid, F.lit(None))
        .when(F.col("c.i") == F.col("k"), new)
        .otherwise(other)
    )
    return rows.select(*keys, "scenario", F.col("c.i").alias("i"), F.col("c.name").alias("name"), value.alias("weight"))


def aggregate_judgements(matrix: DataFrame) -> DataFrame:
    """Element-wise geometric mean over respondents, diagonal fixed at one."""
    combined = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.exp(F.avg(F.ln("a"))))
    return matrix.groupBy("i", "j").agg(combined.alias("a"))


def group_solution(matrix: DataFrame, *, max_cr: float = MAX_CR, exclude_inconsistent: bool = True) -> tuple[DataFrame, DataFrame]:
    """(group result, respondent report). Rejected respondents leave the mean but stay in the report."""
    solved = solve(matrix, max_cr=max_cr)
    used = matrix
    if exclude_inconsistent:
        used = matrix.join(solved.where("accepted").select("respondent"), "respondent", "left_semi")
    group = solve(aggregate_judgements(used).withColumn("respondent", F.lit("group")), max_cr=max_cr)
    return group, solved.select("respondent", "cr", "accepted")
