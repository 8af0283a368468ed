"""Two candidate layers for one criterion, judged by an independent layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import correlation
from aridscape.operators.stats import column_quantiles, spearman


def compare_layers(layers: DataFrame, a: str, b: str, independent: str, *, names: Sequence[str] = ("a", "b"), **options) -> DataFrame:
    """One row: statistics of both layers, their correlations, and the one closer to the independent layer."""
    medians = column_quantiles(layers, [a, b], [0.5], **options)
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
            for k, x, y in (("ab", a, b), ("a", a, independent), ("b", b, independent))
        ]
    )
    tall = layers.select(F.explode(pairs).alias("p")).select("p.*")
    rho = {r["pair"]: r["rho"] for r in spearman(tall, "x", "y", groups=["pair"], **options).collect()}
    statistics = [
        f(c).alias(f"{name}_{label}")
        for c, name in ((a, names[0]), (b, names[1]))
        for label, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
    ]
    closer = names[0] if abs(rho.get("a") or 0.0) >= abs(rho.get("b") or 0.0) else names[1]
    return layers.agg(
        *statistics,
        *[F.lit(medians[c][0]).alias(f"{name}_median") for c, name in ((a, names[0]), (b, names[1]))],
        correlation(F.col(a), F.col(b)).alias("pearson"),
        F.lit(rho.get("ab")).cast("double").alias("spearman"),
        F.lit(rho.get("a")).cast("double").alias(f"rho_{names[0]}"),
        F.lit(rho.get("b")).cast("double").alias(f"rho_{names[1]}"),
        F.lit(closer).alias("better"),
    )
