"""Class breaks, class maps and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aridscape.functions.columns import ratio
from aridscape.operators.stats import column_quantiles

METHODS = ("jenks", "equal_interval", "quantile")
BARS = 1024
SPLIT = 64


def histogram(df: DataFrame, value: str, bins: int, *, low: float, high: float) -> DataFrame:
    """Equal-width bins with count, sum, minimum and maximum; map-side combined."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(index.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.sum(value).alias("total"),
            F.sum((F.col(value) - low) * (F.col(value) - low)).alias("squares"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
        )
    )


def value_edges(data: DataFrame, low: float, high: float, bars: int) -> list[float]:
    """Edges of equal counts and of equal widths together, so that neither a crowded
    nor a stretched part of the range falls into one bar."""
    probs = F.array(*[F.lit(i / bars) for i in range(1, bars)])
    marks = data.agg(F.percentile_approx("v", probs, 8 * bars)).first()[0]
    return sorted({float(m) for m in marks} | set(np.linspace(low, high, bars + 1).tolist()))


def value_bars(data: DataFrame, edges: Sequence[float], centre: float) -> dict[str, np.ndarray]:
    """Rows between neighbouring edges: count, centred sum and squares, least and greatest value."""
    splits = [-math.inf, *edges, math.inf]
    gap = F.col("v") - F.lit(centre)
    rows = (
        Bucketizer(splits=splits, inputCol="v", outputCol="bar")
        .transform(data)
        .groupBy("bar")
        .agg(F.count("*").alias("n"), F.sum(gap).alias("total"), F.sum(gap * gap).alias("squares"), F.min("v").alias("least"), F.max("v").alias("most"))
        .orderBy("bar")
        .collect()
    )
    return {c: np.array([r[c] for r in rows], dtype="float64") for c in ("n", "total", "squares", "least", "most")}


def _optimal_cuts(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> list[int]:
    """Last bin of each of ``k`` groups minimising within-group squares (Fisher's dynamic program)."""
    cn, cs, cq = (np.concatenate(([0.0], np.cumsum(v))) for v in (n, s, q))
    m = n.size
    if m < k:
        raise ValueError(f"{m} bars cannot be cut into {k} groups")

    def cost(starts: np.ndarray, stop: int) -> np.ndarray:
        count = cn[stop] - cn[starts]
        return (cq[stop] - cq[starts]) - (cs[stop] - cs[starts]) ** 2 / count

    best = np.array([np.inf] + [cost(np.array([0]), e)[0] for e in range(1, m + 1)])
    choice = np.zeros((k + 1, m + 1), dtype="int64")
    for groups in range(2, k + 1):
        updated = np.full(m + 1, np.inf)
        for stop in range(groups, m + 1):
            starts = np.arange(groups - 1, stop)
            total = best[starts] + cost(starts, stop)
            pick = int(np.argmin(total))
            updated[stop], choice[groups, stop] = total[pick], starts[pick]
        best = updated
    cuts, stop = [m - 1], m
    for groups in range(k, 1, -1):
        stop = int(choice[groups, stop])
        cuts.append(stop - 1)
    return cuts[::-1]


def natural_breaks(data: DataFrame, low: float, high: float, n_classes: int, bars: int = BARS) -> list[float]:
    """Upper bounds of the ``n_classes`` groups of ``v`` with the least squares within.

    The cluster reduces all rows to bars, a dynamic program on the driver cuts
    them, and bars beside a cut are split until each holds one value. Bars
    grow with ``bars`` and the number of classes, not with the data.
    """
    edges = value_edges(data, low, high, bars)
    while True:
        found = value_bars(data, edges, (low + high) / 2)
        several = found["least"] < found["most"]
        if found["n"].size < n_classes:
            if not several.any():
                raise ValueError(f"only {found['n'].size} distinct values for {n_classes} classes")
            beside = np.flatnonzero(several)
        else:
            cuts = _optimal_cuts(found["n"], found["total"], found["squares"], n_classes)
            near = {c + k for c in cuts[:-1] for k in (0, 1)}
            beside = np.array([i for i in sorted(near) if several[i]], dtype="int64")
            if not beside.size:
                return [*[float(found["most"][c]) for c in cuts[:-1]], float(high)]
        fresh = [np.linspace(found["least"][i], found["most"][i], SPLIT + 1)[1:] for i in beside]
        edges = sorted(set(edges) | set(np.concatenate(fresh).tolist()))


def compute_breaks(df: DataFrame, value: str, *, method: str = "jenks", n_classes: int = 5, bars: int = BARS) -> list[float]:
    """Upper class bounds; the last one is the maximum."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    if n_classes < 2:
        raise ValueError(f"at least two classes are needed, got {n_classes}")
    data = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    head = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    low, high = head["lo"], head["hi"]
    if low is None:
        raise ValueError("no defined value to classify")
    if method == "jenks":
        return natural_breaks(data, low, high, n_classes, bars)
    distinct = data.select("v").distinct().limit(n_classes).count()
    if distinct < n_classes:
        raise ValueError(f"only {distinct} distinct values for {n_classes} classes")
    if method == "equal_interval":
        return np.linspace(low, high, n_classes + 1)[1:].tolist()
    probs = np.linspace(0, 1, n_classes + 1)[1:].tolist()
    return column_quantiles(data, ["v"], probs)["v"]


def apply_breaks(value: Column, breaks: Sequence[float], n_classes: int | None = None) -> Column:
    """Right-closed classes 1..k, 0 for null."""
    if n_classes is not None and len(breaks) != n_classes:
        raise ValueError(f"{n_classes} classes need {n_classes} breaks, got {len(breaks)}")
    result = F.when(value.isNull() | F.isnan(value), F.lit(0))
    for code, upper in enumerate(breaks[:-1], start=1):
        result = result.when(value <= F.lit(float(upper)), F.lit(code))
    return result.otherwise(F.lit(len(breaks)))


def class_summary(classes: DataFrame, cell_km2: float, *, code: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """Cells, share of valid and area per class, a total row (null class) and the masked row (class 0)."""
    keys = list(keys)
    counted = classes.groupBy(*keys, code).agg(F.count("*").alias("cells"))
    return (
        counted.groupBy(*keys)
        .agg(
            F.sum(F.when(F.col(code) > 0, F.col("cells"))).alias("valid"),
            F.collect_list(F.struct(F.col(code).alias("class"), F.col("cells"))).alias("rows"),
        )
        .select(*keys, "valid", F.explode(F.concat("rows", F.array(F.struct(F.lit(None).cast("int").alias("class"), F.col("valid").alias("cells"))))).alias("r"))
        .select(
            *keys,
            F.col("r.class").alias("class"),
            F.col("r.cells").alias("cells"),
            F.when(F.coalesce("r.class", F.lit(1)) > 0, 100 * ratio(F.col("r.cells").cast("double"), F.col("valid").cast("double"))).alias("share_pct"),
            (F.col("r.cells") * cell_km2).alias("area_km2"),
        )
    )


def risk_histogram(df: DataFrame, value: str, breaks: Sequence[float], *, bins: int = 120) -> DataFrame:
    """Equal bins over the value range, each with the class of its centre."""
    head = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    low, high = head["lo"], head["hi"]
    width = (high - low) / bins
    centre = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    return histogram(df, value, bins, low=low, high=high).select(
        "bin", centre.alias("centre"), "n", apply_breaks(centre, breaks).alias("class")
    )


def _weighted_centres(v: np.ndarray, w: np.ndarray, k: int, restarts: int, seed: int) -> list[float]:
    """Best of several one-dimensional k-means runs on weighted bars."""
    rng = np.random.default_rng(seed)
    best, best_cost = None, np.inf
    for _ in range(restarts):
        centres = np.sort(rng.choice(v, size=k, replace=False, p=w / w.sum()))
        for _ in range(300):
            nearest = np.searchsorted((centres[:-1] + centres[1:]) / 2, v)
            mass = np.bincount(nearest, w, minlength=k)
            moved = np.sort(np.where(mass > 0, np.bincount(nearest, w * v, minlength=k) / np.maximum(mass, 1e-300), centres))
            settled = np.allclose(moved, centres, rtol=0, atol=1e-12)
            centres = moved
            if settled:
                break
        cost = float((w * (v - centres[np.searchsorted((centres[:-1] + centres[1:]) / 2, v)]) ** 2).sum())
        if cost < best_cost:
            best, best_cost = centres, cost
    return best.tolist()


def kmeans_agreement(df: DataFrame, value: str, breaks: Sequence[float], *, bars: int = BARS, seed: int = 0, restarts: int = 10) -> DataFrame:
    """Share of rows that k-means puts in the same ordered class as ``breaks``.

    The clusters are fitted on the bars the cluster reduced the data to;
    the agreement is counted on every row. In one dimension a cluster ends
    halfway between neighbouring centres, so membership is a plain projection.
    """
    data = df.select(F.col(value).cast("double").alias("v")).where(F.col(value).isNotNull())
    head = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    centre = (head["lo"] + head["hi"]) / 2
    found = value_bars(data, value_edges(data, head["lo"], head["hi"], bars), centre)
    if found["n"].size < len(breaks):
        raise ValueError(f"only {found['n'].size} distinct values for {len(breaks)} clusters")
    centres = _weighted_centres(centre + found["total"] / found["n"], found["n"], len(breaks), restarts, seed)
    borders = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    same = apply_breaks(F.col(value), breaks) == apply_breaks(F.col(value), [*borders, float("inf")])
    return df.where(F.col(value).isNotNull()).agg(F.avg(same.cast("double")).alias("agreement"), F.count("*").alias("n"))
