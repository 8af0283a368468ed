"""Raw layer -> 0..1 risk score."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import clip
from aridscape.operators.stats import column_quantiles, column_stats

METHODS = ("minmax_percentile", "minmax_capped", "lookup", "none")


class NormalizationError(ValueError):
    """The layer cannot be scored as configured."""


@dataclass(frozen=True)
class Criterion:
    """How one raw layer becomes a score."""

    name: str
    method: str
    higher_is_riskier: bool
    percentiles: tuple[float, float] = (2.0, 98.0)
    log_transform: bool = False
    cap: float | None = None
    label: str = ""

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise NormalizationError(f"{self.name}: unknown method {self.method!r}, expected one of {METHODS}")
        low, high = self.percentiles
        if not 0 <= low < high <= 100:
            raise NormalizationError(f"{self.name}: invalid percentiles {self.percentiles}")
        if self.method == "minmax_capped" and not (self.cap and self.cap > 0):
            raise NormalizationError(f"{self.name}: minmax_capped needs a positive cap")

    def scaled_input(self, raw: Column) -> Column:
        return F.log1p(raw) if self.log_transform else raw


def rescale(value: Column, low: float, high: float) -> Column:
    return clip((value - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def directed(score: Column, higher_is_riskier: bool) -> Column:
    return score if higher_is_riskier else F.lit(1.0) - score


def percentile_bounds(df: DataFrame, criteria: Sequence[Criterion], **options) -> dict[str, tuple[float, float]]:
    """(low, high) per percentile-scaled criterion, all layers in one go.

    Percentiles are taken after the log transform: interpolation between two
    order statistics does not commute with it.
    """
    chosen = [c for c in criteria if c.method == "minmax_percentile"]
    if not chosen:
        return {}
    probs = sorted({p / 100 for c in chosen for p in c.percentiles})
    quantiles = column_quantiles(df, {c.name: c.scaled_input(F.col(c.name)) for c in chosen}, probs, **options)
    bounds = {}
    for c in chosen:
        low, high = (quantiles[c.name][probs.index(p / 100)] for p in c.percentiles)
        if not high > low:
            raise NormalizationError(f"{c.name}: percentiles {c.percentiles} coincide at {low}: constant layer")
        bounds[c.name] = (low, high)
    return bounds


def check_raw(criteria: Sequence[Criterion], stats: Mapping[str, tuple]) -> None:
    """Reject empty, negative-under-log and out-of-range layers from their ranges."""
    for c in criteria:
        n, low, high = stats[c.name]
        if not n:
            raise NormalizationError(f"{c.name}: the layer has no defined cell")
        if c.log_transform and low < 0:
            raise NormalizationError(f"{c.name}: log transform with negative values")
        if c.method in ("lookup", "none") and (low < -1e-6 or high > 1 + 1e-6):
            raise NormalizationError(f"{c.name}: expected values in 0..1, found [{low}, {high}]")


def score_column(criterion: Criterion, bounds: Mapping[str, tuple[float, float]]) -> Column:
    raw = F.col(criterion.name)
    if criterion.method == "minmax_percentile":
        score = rescale(criterion.scaled_input(raw), *bounds[criterion.name])
    elif criterion.method == "minmax_capped":
        score = clip(raw / F.lit(float(criterion.cap)), 0.0, 1.0)
    else:
        score = clip(raw, 0.0, 1.0)
    return directed(score, criterion.higher_is_riskier)


def score_layers(df: DataFrame, criteria: Sequence[Criterion], *, keep: Sequence[str] = ("cell_id",), **options) -> DataFrame:
    """Score every criterion column in one projection; bounds enter as literals."""
    stats = column_stats(df, [c.name for c in criteria])
    check_raw(criteria, stats)
    # the transform is monotone, so transformed ranges follow from the raw ones
    moved = {c.name: (n, math.log1p(low), math.log1p(high)) if c.log_transform else (n, low, high) for c in criteria for n, low, high in [stats[c.name]]}
    bounds = percentile_bounds(df, criteria, stats=moved, **options)
    return df.select(*keep, *[score_column(c, bounds).alias(c.name) for c in criteria])


def lookup_scores(cells: DataFrame, table: DataFrame, *, code: str = "code", output: str = "score", max_masked: float = 0.5, ignore: Sequence[int] = (0,)) -> DataFrame:
    """Attach the class score; null scores mask. Unknown codes and a mostly masked area are errors.

    ``table`` is a code list (a handful of rows); the engine broadcasts it by
    its size.
    """
    # one grouped count answers both questions; codes are few by type
    counts = cells.groupBy(code).agg(F.count("*").alias("n")).join(table.withColumn("_known", F.lit(True)), code, "left")
    bad = F.col(code).isNotNull() & ~F.col(code).isin(*ignore) & F.col("_known").isNull()
    head = counts.agg(
        F.sort_array(F.collect_list(F.when(bad, F.col(code)))).alias("unknown"),
        F.try_divide(F.sum(F.when(F.col("score").isNull(), F.col("n"))), F.sum("n")).alias("masked"),
    ).first()
    if head["unknown"]:
        raise ValueError(f"class codes without an entry in the lookup table: {head['unknown'][:20]}")
    if (head["masked"] or 0.0) > max_masked:
        raise ValueError(f"{head['masked']:.0%} of the area is masked: check the lookup table")
    return cells.join(table.select(code, F.col("score").alias(output)), code, "left")


def profile(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """One row per layer: mean, median, p10, p90, min, max and masked share."""
    quantiles = column_quantiles(df, columns, [0.1, 0.5, 0.9], **options)
    rows = [
        F.struct(
            F.lit(c).alias("layer"),
            F.avg(c).alias("mean"),
            F.lit(quantiles[c][1]).alias("median"),
            F.lit(quantiles[c][0]).alias("p10"),
            F.lit(quantiles[c][2]).alias("p90"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            F.avg(F.col(c).isNull().cast("double")).alias("masked_share"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


# --- criterion registry ------------------------------------------------------------

RawBuilder = Callable[[DataFrame], Column]
_BUILDERS: dict[str, RawBuilder] = {}


def raw_criterion(name: str) -> Callable[[RawBuilder], RawBuilder]:
    """Register how a raw criterion column is derived from the aligned cell table."""

    def register(builder: RawBuilder) -> RawBuilder:
        _BUILDERS[name] = builder
        return builder

    return register


def build_criteria(cells: DataFrame, criteria: Sequence[Criterion], *, keep: Sequence[str] = ("cell_id",), builders: Mapping[str, RawBuilder] | None = None, **options) -> DataFrame:
    """Derive and score all criteria as one lazy wide plan."""
    known = {**_BUILDERS, **(builders or {})}
    missing = [c.name for c in criteria if c.name not in known]
    if missing:
        raise KeyError(f"no raw builder registered for {missing}")
    raw = cells.select(*keep, *[known[c.name](cells).alias(c.name) for c in criteria])
    return score_layers(raw, criteria, keep=keep, **options)
