"""Criteria to classified risk map, with its diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.operators.classify import apply_breaks, class_summary, compute_breaks
from aridscape.operators.normalize import Criterion, score_layers
from aridscape.operators.overlay import contributions, risk_column, risk_summary, sensitivity, check_weights, coverage
from aridscape.operators.weighting import perturbed, require_consistent, solve, weight_rows
from aridscape.session import cut_lineage
from aridscape.sources.grid import GridSpec


@dataclass(frozen=True)
class RiskMap:
    """Scores, index and class per cell, and what was derived from them."""

    cells: DataFrame
    weights: dict[str, float]
    breaks: list[float]
    summary: DataFrame
    classes: DataFrame
    contributions: DataFrame
    coverage: DataFrame


def criterion_weights(matrix: DataFrame, criteria: Sequence[str], *, max_cr: float = 0.10) -> dict[str, float]:
    """Weights of one configured matrix; an inconsistent one is rejected."""
    solved = require_consistent(solve(matrix, max_cr=max_cr))
    rows = {r["i"]: r["weight"] for r in weight_rows(solved).collect()}
    if len(rows) != len(criteria):
        raise ValueError(f"{len(criteria)} criteria need a matrix of that size, got {len(rows)}")
    return {name: rows[k] for k, name in enumerate(criteria)}


def build_risk_map(
    raw: DataFrame,
    criteria: Sequence[Criterion],
    weights: Mapping[str, float],
    grid: GridSpec,
    *,
    method: str = "jenks",
    n_classes: int = 5,
    keep: Sequence[str] = ("cell_id",),
    **overlay_options,
) -> RiskMap:
    """Score, overlay, classify.

    The scored stack is materialised once in the checkpoint folder: breaks,
    summaries and sensitivity all scan it, and none re-reads the raw layers.
    """
    names = [c.name for c in criteria]
    check_weights(weights, names)
    scored = score_layers(raw, criteria, keep=keep)
    stack = cut_lineage(scored.withColumn("risk", risk_column(weights, **overlay_options)))
    if stack.where(F.col("risk").isNotNull()).isEmpty():
        raise ValueError("no cell has all criteria defined")
    breaks = compute_breaks(stack, "risk", method=method, n_classes=n_classes)
    classified = stack.withColumn("class", apply_breaks(F.col("risk"), breaks, n_classes))
    return RiskMap(
        cells=classified,
        weights=dict(weights),
        breaks=breaks,
        summary=risk_summary(stack),
        classes=class_summary(classified.select("class"), grid.cell_km2),
        contributions=contributions(stack, weights),
        coverage=coverage(stack, names),
    )


def weight_sensitivity(result: RiskMap, *, perturbation: float = 0.10, **options) -> DataFrame:
    """One-at-a-time weight changes judged against the baseline map."""
    spark = result.cells.sparkSession
    table = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(result.weights.items())], "i int, name string, weight double")
    sets: dict[str, dict[str, float]] = {}
    for row in perturbed(table.withColumn("respondent", F.lit("map")), perturbation).collect():
        if row["weight"] is None:
            raise ValueError(f"{row['scenario']}: the perturbation leaves no valid weights")
        if row["scenario"] != "baseline":
            sets.setdefault(row["scenario"], {})[row["name"]] = row["weight"]
    ordered = {s: {n: w[n] for n in result.weights} for s, w in sets.items()}
    return sensitivity(result.cells, result.weights, ordered, result.breaks, **options)
