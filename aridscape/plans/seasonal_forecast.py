"""Summer stress from what is known in spring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from aridscape.operators.forecast import (
    PREDICTORS,
    REGION,
    best_predictor,
    describe_predictors,
    ridge_skill,
    seasonal_baselines,
    seasonal_dataset,
    split_rejections,
    univariate_skill,
)


def seasonal_forecast(series: DataFrame, *, target: str = "soil", keys: Sequence[str] = REGION, predictors: Sequence[str] = PREDICTORS, **gates) -> dict[str, DataFrame]:
    """Predictor table, description, baselines, one-variable skills, the best
    predictor, ridge on all of them, and the regions too short for any of it."""
    dataset = seasonal_dataset(series, target=target, keys=keys)
    used = [p for p in predictors if p in dataset.columns]
    baseline_gates = {k: v for k, v in gates.items() if k in ("train_fraction", "min_train", "min_test")}
    skills = univariate_skill(dataset, used, keys=keys, **gates)
    ridge, coefficients = ridge_skill(dataset, used, keys=keys, **baseline_gates)
    return {
        "dataset": dataset,
        "description": describe_predictors(dataset, used, keys=keys),
        "baselines": seasonal_baselines(dataset, keys=keys, **baseline_gates),
        "skills": skills,
        "best": best_predictor(skills, keys=keys),
        "ridge": ridge,
        "ridge_coefficients": coefficients,
        "rejected": split_rejections(dataset, "target", keys=keys, train_fraction=baseline_gates.get("train_fraction", 0.7), min_train=baseline_gates.get("min_train", 15), min_test=baseline_gates.get("min_test", 10)),
    }
