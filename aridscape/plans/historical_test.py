"""Risk against observed impact over a long record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.operators.anomaly import MIN_LONG_BASELINE_YEARS, by_class, leave_one_out, require_years, signed
from aridscape.operators.classify import apply_breaks, compute_breaks
from aridscape.operators.overlay import dropped_weights, risk_column
from aridscape.operators.validate import MIN_EFFECT, group_means, pooled_class_means, verdict, yearly_test


def dry_labels(severity: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Label years by their severity; a year without data is not dry."""
    return severity.withColumn("is_dry", F.coalesce(F.col("severity") <= threshold, F.lit(False)))


def long_record_anomalies(impact: DataFrame, source: str, value: str = "value", *, min_baseline: int = MIN_LONG_BASELINE_YEARS, standardize: bool = False) -> DataFrame:
    """All years of one source in one pass, oriented so low means damage."""
    require_years(impact, min_baseline)
    return leave_one_out(signed(impact, source, value), value, standardize=standardize).select("cell_id", "year", "anomaly")


def historical_test(anomalies: DataFrame, risk: DataFrame, labels: DataFrame, *, keys: Sequence[str] = (), min_pairs: int = 100, **options) -> dict[str, DataFrame]:
    """Yearly outcomes, pooled class means of dry and of all years, and the verdict.

    ``risk`` carries ``cell_id, risk, class`` (and ``keys``), already limited
    to the land cover under test.
    """
    keys = list(keys)
    joined = anomalies.join(risk.select("cell_id", "risk", "class", *keys), "cell_id")
    yearly = yearly_test(joined, labels, keys=keys, min_pairs=min_pairs, **options)
    means = by_class(joined, "anomaly", "class", keys=[*keys, "year"])
    return {
        "yearly": yearly,
        "pooled_dry": pooled_class_means(means, labels, keys=keys),
        "pooled_all": pooled_class_means(means, labels, dry_only=False, keys=keys),
        "verdict": verdict(group_means(yearly, keys=keys), need_other=True),
    }


def criterion_drop_test(stack: DataFrame, weights: Mapping[str, float], drop: Sequence[str], anomalies: DataFrame, labels: DataFrame, *, method: str = "jenks", min_pairs: int = 100, digits: int = 9, **options) -> DataFrame:
    """Does leaving out criteria make the map predict impact in dry years?

    The full and the reduced map are two variants of one tall table, so both
    go through the same test together.
    """
    maps = {"full": dict(weights), "reduced": dropped_weights(weights, drop)}
    risks = stack.select("cell_id", *[F.round(risk_column(w), digits).alias(n) for n, w in maps.items()])
    variants = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), F.col(n).alias("risk"), apply_breaks(F.col(n), compute_breaks(risks, n, method=method)).alias("class"))
            for n in maps
        ]
    )
    tall = risks.select("cell_id", F.explode(variants).alias("m")).select("cell_id", "m.*")
    joined = anomalies.join(tall, "cell_id")
    means = group_means(yearly_test(joined, labels, keys=["variant"], min_pairs=min_pairs, **options), keys=["variant"])
    rho = lambda name: F.max(F.when(F.col("variant") == name, F.col("dry_rho")))
    both = means.agg(rho("full").alias("full_rho"), rho("reduced").alias("reduced_rho"))
    return both.withColumn(
        "verdict",
        F.when(F.col("reduced_rho") <= -MIN_EFFECT, "supported")
        .when(F.col("reduced_rho") < F.col("full_rho"), "rejected_still_weak")
        .otherwise("rejected_weaker"),
    )
