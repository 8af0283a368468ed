"""Weighted overlay and what its weights do to the map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import clip, defined, ratio
from aridscape.operators.classify import apply_breaks, compute_breaks
from aridscape.operators.stats import Marks, bucket_count, column_quantiles, ranked_correlation, significant, with_rank
from aridscape.session import cut_lineage

MITIGATION = 0.30
MITIGATING_CRITERION = "distance_to_water"


def stack_layers(layers: DataFrame, names: Sequence[str], *, cell: str = "cell_id", layer: str = "layer", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Tall ``keys, cell, layer, value`` -> one column per layer in a single shuffle.

    Aggregating instead of joining k layers moves each value once and needs no
    sort. A layer that is absent is an error; a cell missing a value is null.
    """
    present = {r[layer] for r in layers.where(F.col(layer).isin(*names)).select(layer).distinct().collect()}
    missing = [n for n in names if n not in present]
    if missing:
        raise FileNotFoundError(f"layers not built yet: {missing}")
    return (
        layers.where(F.col(layer).isin(*names))
        .groupBy(*keys, cell)
        .agg(*[F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names])
    )


def with_mask(stack: DataFrame, names: Sequence[str]) -> DataFrame:
    return stack.withColumn("valid", defined(F.col(n) for n in names))


def coverage(stack: DataFrame, names: Sequence[str]) -> DataFrame:
    valid = defined(F.col(n) for n in names)
    return stack.agg(
        F.count("*").alias("cells"),
        F.sum(valid.cast("long")).alias("valid_cells"),
        F.avg(valid.cast("double")).alias("coverage"),
    )


def check_weights(weights: Mapping[str, float], names: Sequence[str]) -> None:
    if set(weights) != set(names):
        raise ValueError(f"weights for {sorted(weights)} do not match criteria {sorted(names)}")
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights must sum to one, got {sum(weights.values())}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")


def risk_column(weights: Mapping[str, float], *, mitigation: float = MITIGATION, mitigating: str = MITIGATING_CRITERION, scores: Mapping[str, Column] | None = None) -> Column:
    """Weighted sum as one expression; any missing criterion leaves the cell undefined.

    Closeness to water lowers the sum by up to ``mitigation``; pass zero for
    the plain sum.
    """
    score = lambda n: (scores or {}).get(n, F.col(n))
    total = None
    for name, weight in weights.items():
        term = F.lit(float(weight)) * score(name)
        total = term if total is None else total + term
    if mitigation and mitigating in weights:
        total = total * (F.lit(1.0) - F.lit(mitigation) * (F.lit(1.0) - score(mitigating)))
    return total


def weighted_overlay(stack: DataFrame, weights: Mapping[str, float], *, output: str = "risk", names: Sequence[str] | None = None, **options) -> DataFrame:
    check_weights(weights, names or list(weights))
    return stack.withColumn(output, risk_column(weights, **options))


def risk_summary(df: DataFrame, risk: str = "risk", **options) -> DataFrame:
    median = column_quantiles(df, [risk], [0.5], **options)[risk][0]
    return df.agg(
        F.count(risk).alias("n"),
        F.min(risk).alias("min"),
        F.max(risk).alias("max"),
        F.avg(risk).alias("mean"),
        F.lit(median).alias("median"),
    )


def contributions(stack: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Nominal weight against the spread each criterion really adds (valid cells, population std)."""
    names = list(weights)
    spreads = {n: F.stddev_pop(F.lit(float(weights[n])) * F.col(n)) for n in names}
    rows = [
        F.struct(
            F.lit(n).alias("criterion"),
            F.lit(float(weights[n])).alias("weight"),
            F.min(n).alias("low"),
            F.max(n).alias("high"),
            spreads[n].alias("spread"),
        )
        for n in names
    ]
    total = sum(spreads.values(), F.lit(0.0))
    return (
        stack.where(defined(F.col(n) for n in names))
        .agg(F.array(*rows).alias("rows"), total.alias("total"))
        .select(F.explode("rows").alias("r"), "total")
        .select("r.*", F.coalesce(ratio(F.col("r.spread"), F.col("total")), F.lit(0.0)).alias("share"))
    )


def sensitivity(stack: DataFrame, baseline: Mapping[str, float], scenarios: Mapping[str, Mapping[str, float]], breaks: Sequence[float], *, digits: int = 12, buckets: int | None = None) -> DataFrame:
    """Per weight scenario: index shift, class agreement under baseline breaks, rank correlation.

    All indices of a cell come from one projection and stay on its row: shifts
    and agreement are aggregated before any shuffle, and the baseline is ranked
    once for all scenarios. Only the ranks of the scenarios need (scenario,
    index, baseline rank) to meet by value.
    """
    rounded = lambda weights: significant(F.round(risk_column(weights), digits), digits)
    cells = stack.where(defined(F.col(n) for n in baseline))
    rows = cut_lineage(cells.select(rounded(baseline).alias("x"), F.array(*[rounded(w) for w in scenarios.values()]).alias("ys")))
    names = F.array(*[F.lit(s) for s in scenarios])

    def measures(i: int, name: str) -> Column:
        y = F.col("ys")[i]
        same = apply_breaks(y, breaks) == apply_breaks(F.col("x"), breaks)
        shift = F.abs(y - F.col("x"))
        return F.struct(
            F.lit(name).alias("scenario"), F.avg(shift).alias("mean_abs_diff"), F.max(shift).alias("max_abs_diff"),
            F.avg(same.cast("double")).alias("class_agreement"),
        )

    metrics = rows.agg(F.array(*[measures(i, s) for i, s in enumerate(scenarios)]).alias("m")).select(F.inline("m"))
    tall = lambda df, *keep: df.select(*keep, F.posexplode("ys").alias("_scenario", "y"))
    count = bucket_count(stack, buckets)
    (marks_x,) = Marks.measure(rows, ["x"], count)
    (marks_y,) = Marks.measure(tall(rows), ["y"], count)
    base = with_rank(rows, "x", [], marks_x, rows, "ys", "_rx")
    both = with_rank(tall(base, "_rx"), "y", ["_scenario"], marks_y, tall(rows), "_rx", "_ry")
    rho = ranked_correlation(both, "_rx", "_ry", groups=["_scenario"], min_n=1)
    rho = rho.select(F.element_at(names, F.col("_scenario") + 1).alias("scenario"), F.coalesce("rho", F.lit(1.0)).alias("spearman_rho"))
    return metrics.join(rho, "scenario")


def agreement(pair: DataFrame, risk_a: str, risk_b: str, class_a: str, class_b: str) -> DataFrame:
    """Two maps on the same cells: index difference and class agreement."""
    gap = F.abs(F.col(risk_a) - F.col(risk_b))
    steps = F.abs(F.col(class_a) - F.col(class_b))
    return pair.where(F.col(risk_a).isNotNull() & F.col(risk_b).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(gap).alias("mean_abs_diff"),
        F.max(gap).alias("max_abs_diff"),
        F.avg((steps == 0).cast("double")).alias("class_agreement"),
        F.avg((steps <= 1).cast("double")).alias("within_one_class"),
    )


def classified(df: DataFrame, risk: str, *, output: str, **options) -> DataFrame:
    """Break and classify one index column."""
    return df.withColumn(output, apply_breaks(F.col(risk), compute_breaks(df, risk, **options)))


def dropped_weights(weights: Mapping[str, float], drop: Sequence[str]) -> dict[str, float]:
    """Zero the dropped criteria and scale the others back to one, ratios kept."""
    unknown = [d for d in drop if d not in weights]
    if unknown:
        raise ValueError(f"unknown criteria {unknown}")
    kept = sum(w for n, w in weights.items() if n not in drop)
    if kept <= 0:
        raise ValueError("not all criteria can be dropped")
    return {n: 0.0 if n in drop else w / kept for n, w in weights.items()}


def layer_spread(stack: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.stddev_pop(n).alias("std")) for n in names])
    return stack.where(defined(F.col(n) for n in names)).agg(rows.alias("r")).select(F.inline("r"))


def prediction_risk(df: DataFrame, prediction: str = "prediction", *, output: str = "risk") -> DataFrame:
    """Predicted loss turned into a 0..1 index; the range is one small aggregation."""
    head = df.agg(F.min(-F.col(prediction)).alias("lo"), F.max(-F.col(prediction)).alias("hi")).first()
    return df.withColumn(output, clip((-F.col(prediction) - head["lo"]) / (head["hi"] - head["lo"] + 1e-9), 0.0, 1.0))
