"""Drought indices of many regions: summaries, events, state and forecast skill."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.operators.drought import REGION, current_state, drought_events, spi, spi_summary
from aridscape.operators.forecast import benchmark


def spi_at_scales(series: DataFrame, value: str = "ppt", scales: Sequence[int] = (3, 6, 12), *, keys: Sequence[str] = REGION, **options) -> DataFrame:
    """``keys, month, scale, spi`` for every accumulation scale."""
    parts = [
        spi(series.select(*keys, "month", value), value, s, keys=keys, **options).select(*keys, "month", F.lit(s).alias("scale"), "spi")
        for s in scales
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def monitor(indices: DataFrame, *, keys: Sequence[str] = REGION, event_scale: int = 12, forecast_scale: int = 3, threshold: float = -1.0, **benchmark_options) -> dict[str, DataFrame]:
    """Everything the monthly bulletin reads; each entry is a small table per region."""
    by_scale = [*keys, "scale"]
    return {
        "summary": spi_summary(indices, keys=by_scale),
        "state": current_state(indices, keys=by_scale),
        "events": drought_events(indices.where(F.col("scale") == event_scale), threshold=threshold, keys=keys),
        "skill": benchmark(indices.where(F.col("scale") == forecast_scale), "spi", keys=keys, drought=threshold, **benchmark_options),
    }
