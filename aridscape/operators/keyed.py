"""The risk chain for many grids or regions in one plan.

Exact quantiles of every group are refined together: the wanted ranks are rows
of a small table with the bounds they are known to lie in, each pass counts the
values between those bounds per bin (map-side combined) and the table is
narrowed by a join. No group is collected, and none is looped over. Results are
tables by key, joined to the rows. A group that cannot be scored or classified
is a row of the rejections and leaves the others alone.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.functions.columns import clip, ratio
from aridscape.operators.classify import METHODS, _optimal_cuts
from aridscape.operators.normalize import Criterion, directed
from aridscape.session import cut_lineage

#: Bins per interval and pass.
BINS = 512
#: Values of an interval that may meet in one row.
FEW = 4096
#: First bars of a group's natural breaks, and parts of a bar that is split.
BARS, SPLIT = 128, 16


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


# --- quantiles -----------------------------------------------------------------


def keyed_quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """``keys`` and, per column, its count, range and linear-interpolation quantiles:
    a struct (n, low, high, q array<double>). NaN counts as missing."""
    keys, probs = list(keys), [float(p) for p in probs]
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    number = lambda e: F.when(~F.isnan(e.cast("double")), e.cast("double"))
    data = cut_lineage(df.select(*keys, F.array(*[number(e) for e in exprs.values()]).alias("_v")))
    stats = [
        F.struct(F.lit(i).alias("_c"), F.count(v).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"))
        for i in range(len(exprs))
        for v in [F.col("_v")[i]]
    ]
    ranges = cut_lineage(data.groupBy(*keys).agg(F.array(*stats).alias("s")).select(*keys, F.inline("s")))
    position = F.array(*[F.lit(p) for p in probs])
    places = F.transform(position, lambda p: p * (F.col("_n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x)), F.transform(places, lambda x: F.ceil(x))))
    wanted = ranges.where("_n > 0").select(*keys, "_c", F.explode(ranks).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"))
    found = order_statistics(data, wanted, keys)
    values = found.groupBy(*keys, "_c").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_of"))
    joined = by_keys(ranges, values, [*keys, "_c"], "left")

    def interpolated(x: Column) -> Column:
        low, high = F.col("_of")[F.floor(x)], F.col("_of")[F.ceil(x)]
        return low + (high - low) * (x - F.floor(x))

    quantiles = F.when(F.col("_n") > 0, F.transform(places, interpolated))
    one = joined.select(*keys, "_c", F.struct(F.col("_n").alias("n"), F.col("_low").alias("low"), F.col("_high").alias("high"), quantiles.alias("q")).alias("_s"))
    return one.groupBy(*keys).agg(*[F.first(F.when(F.col("_c") == i, F.col("_s")), ignorenulls=True).alias(n) for i, n in enumerate(exprs)])


def order_statistics(data: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _c, _rank, _value``: the value of each wanted rank (from 0) of column ``_c``
    of ``data`` (keys, ``_v`` array). ``wanted`` bounds each rank: ``_below`` rows lie under
    ``_low`` and ``_inside`` rows from ``_low`` to ``_high``."""
    settled = []
    wanted = cut_lineage(wanted)
    while True:
        same = F.col("_low") == F.col("_high")
        settled.append(wanted.where(same).select(*keys, "_c", "_rank", F.col("_low").alias("_value")))
        few = wanted.where(~same & (F.col("_inside") <= FEW))
        many = wanted.where(~same & (F.col("_inside") > FEW))
        settled.append(_read_off(data, few, keys))
        if not many.take(1):
            return functools.reduce(DataFrame.unionByName, settled)
        wanted = cut_lineage(_narrowed(data, many, keys))


def _inside(data: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``data`` between the bounds of their group's intervals, one row each."""
    bounds = wanted.groupBy(*keys).agg(F.collect_set(F.struct("_c", "_low", "_high")).alias("_of"))
    met = by_keys(data, bounds, keys)
    value = lambda i: F.element_at("_v", i["_c"] + 1)
    hits = F.filter("_of", lambda i: value(i).between(i["_low"], i["_high"]))
    return met.select(*keys, F.explode(F.transform(hits, lambda i: F.struct(i["_c"].alias("_c"), i["_low"].alias("_low"), i["_high"].alias("_high"), value(i).alias("_x")))).alias("h")).select(*keys, "h.*")


def _read_off(data: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    interval = [*keys, "_c", "_low", "_high"]
    values = _inside(data, wanted, keys).groupBy(*interval).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    picked = by_keys(wanted, values, interval)
    return picked.select(*keys, "_c", "_rank", F.element_at("_xs", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_value"))


def _narrowed(data: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    interval = [*keys, "_c", "_low", "_high"]
    bin_of = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1)).cast("int")
    bins = _inside(data, wanted, keys).groupBy(*interval, bin_of.alias("_bin")).agg(F.count("*").alias("_rows"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = F.sum("_rows").over(Window.partitionBy(*interval).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = by_keys(wanted, bins.withColumn("_upto", upto), interval)
    here = F.col("_rank") - F.col("_below")
    met = met.where((here < F.col("_upto")) & (here >= F.col("_upto") - F.col("_rows")))
    return met.select(
        *keys, "_c", "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"),
        (F.col("_below") + F.col("_upto") - F.col("_rows")).alias("_below"), F.col("_rows").alias("_inside"),
    )


# --- scores --------------------------------------------------------------------


def scoring_bounds(df: DataFrame, criteria: Sequence[Criterion], keys: Sequence[str]) -> DataFrame:
    """``keys``, per criterion ``name`` (low, high), and ``reason``: why the group cannot be scored, or null."""
    probs = sorted({p / 100 for c in criteria if c.method == "minmax_percentile" for p in c.percentiles}) or [0.5]
    found = keyed_quantiles(df, {c.name: c.scaled_input(F.col(c.name)) for c in criteria}, probs, keys)
    reasons, bounds = [], []
    for c in criteria:
        s = F.col(c.name)
        reasons.append(F.when(s["n"] == 0, F.lit(f"{c.name}: no defined cell")))
        if c.log_transform:
            raw_low = F.expm1(s["low"])
            reasons.append(F.when(raw_low < 0, F.lit(f"{c.name}: log transform with negative values")))
        if c.method == "minmax_percentile":
            low, high = (s["q"][probs.index(p / 100)] for p in c.percentiles)
            reasons.append(F.when(~(high > low), F.lit(f"{c.name}: constant layer")))
            bounds.append(F.struct(low.alias("low"), high.alias("high")).alias(c.name))
        else:
            if c.method in ("lookup", "none"):
                reasons.append(F.when((s["low"] < -1e-6) | (s["high"] > 1 + 1e-6), F.lit(f"{c.name}: values beyond 0..1")))
            bounds.append(F.struct(F.lit(0.0).alias("low"), F.lit(float(c.cap or 1.0)).alias("high")).alias(c.name))
    return found.select(*keys, *bounds, F.coalesce(*reasons).alias("reason"))


def score_layers_by(df: DataFrame, criteria: Sequence[Criterion], keys: Sequence[str], *, keep: Sequence[str] = ("cell_id",)) -> tuple[DataFrame, DataFrame]:
    """Scores of every group by its own bounds, and the rejected groups with their reasons."""
    bounds = cut_lineage(scoring_bounds(df, criteria, keys))
    renamed = bounds.where("reason IS NULL").select(*keys, *[F.col(c.name).alias(f"_b{i}") for i, c in enumerate(criteria)])
    met = by_keys(df, renamed, keys)
    scores = []
    for i, c in enumerate(criteria):
        b = F.col(f"_b{i}")
        raw = F.col(c.name) if c.method != "minmax_percentile" else c.scaled_input(F.col(c.name))
        scores.append(directed(clip((raw - b["low"]) / (b["high"] - b["low"]), 0.0, 1.0), c.higher_is_riskier).alias(c.name))
    return met.select(*keys, *keep, *scores), bounds.where("reason IS NOT NULL").select(*keys, "reason")


def profile_by(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per group and layer: mean, median, p10, p90, min, max and masked share."""
    quantiles = keyed_quantiles(df, columns, [0.1, 0.5, 0.9], keys)
    means = df.groupBy(*keys).agg(*[F.struct(F.avg(c).alias("mean"), F.avg(F.col(c).isNull().cast("double")).alias("masked")).alias(f"_m{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(
            F.lit(c).alias("layer"), F.col(f"_m{i}.mean").alias("mean"), F.col(c)["q"][1].alias("median"), F.col(c)["q"][0].alias("p10"), F.col(c)["q"][2].alias("p90"),
            F.col(c)["low"].alias("min"), F.col(c)["high"].alias("max"), F.col(f"_m{i}.masked").alias("masked_share"),
        )
        for i, c in enumerate(columns)
    ]
    return by_keys(quantiles, means, keys).select(*keys, F.inline(F.array(*rows)))


def risk_summary_by(df: DataFrame, keys: Sequence[str], risk: str = "risk") -> DataFrame:
    """Count, range, mean and exact median of each group."""
    median = keyed_quantiles(df, [risk], [0.5], keys).select(*keys, F.col(risk)["q"][0].alias("median"))
    sums = df.groupBy(*keys).agg(F.count(risk).alias("n"), F.min(risk).alias("min"), F.max(risk).alias("max"), F.avg(risk).alias("mean"))
    return by_keys(sums, median, keys)


def contributions_by(stack: DataFrame, weights: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Per group: nominal weight against the spread each criterion adds over its valid cells."""
    names = list(weights)
    valid = functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    rows = [
        F.struct(F.lit(n).alias("criterion"), F.lit(float(w)).alias("weight"), F.min(n).alias("low"), F.max(n).alias("high"), F.stddev_pop(F.lit(float(w)) * F.col(n)).alias("spread"))
        for n, w in weights.items()
    ]
    spread = stack.where(valid).groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.aggregate("r", F.lit(0.0), lambda a, r: a + r["spread"]).alias("_total"), F.inline("r"))
    return spread.withColumn("share", F.coalesce(ratio(F.col("spread"), F.col("_total")), F.lit(0.0))).drop("_total")


# --- classes -------------------------------------------------------------------


def class_of(value: Column, breaks: Column) -> Column:
    """Right-closed class 1..k of a value under an array of upper bounds, 0 for missing."""
    upper = F.slice(breaks, 1, F.greatest(F.size(breaks) - 1, F.lit(0)))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.size(F.filter(upper, lambda b: value > b)) + 1)


def breaks_by(df: DataFrame, value: str, keys: Sequence[str], *, method: str = "jenks", n_classes: int = 5, bars: int = BARS) -> DataFrame:
    """``keys, breaks, reason``: upper class bounds of every group, the last its maximum;
    null with a reason where a group has fewer distinct values than classes."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    if n_classes < 2:
        raise ValueError(f"at least two classes are needed, got {n_classes}")
    keys = list(keys)
    x = F.col(value).cast("double")
    data = cut_lineage(df.select(*keys, F.when(~F.isnan(x), x).alias("_x")))
    # distinct values up to the number of classes: least values above the ones before
    several = data.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.approx_count_distinct("_x").alias("_about"))
    doubtful = several.where(F.col("_about") < 4 * n_classes).select(*keys)
    exact = by_keys(data, doubtful, keys).where("_x IS NOT NULL").distinct().groupBy(*keys).agg(F.count("*").alias("_exact"))
    several = by_keys(several, exact, keys, "left").withColumn("_distinct", F.coalesce("_exact", F.when(F.col("_about") < 4 * n_classes, 0).otherwise(F.col("_about"))))
    several = cut_lineage(several.select(*keys, "_low", "_high", "_distinct"))
    enough = F.col("_distinct") >= n_classes
    reason = F.when(~enough, F.concat(F.lit("only "), F.col("_distinct").cast("string"), F.lit(f" distinct values for {n_classes} classes")))
    if method == "equal_interval":
        at = F.array(*[F.lit(i / n_classes) for i in range(1, n_classes + 1)])
        found = several.select(*keys, F.transform(at, lambda p: F.when(p == 1.0, F.col("_high")).otherwise(F.col("_low") + p * (F.col("_high") - F.col("_low")))).alias("breaks"))
    elif method == "quantile":
        found = keyed_quantiles(data, ["_x"], np.linspace(0, 1, n_classes + 1)[1:].tolist(), keys).select(*keys, F.col("_x")["q"].alias("breaks"))
    else:
        found = natural_breaks_by(by_keys(data, several.where(enough).select(*keys), keys).where("_x IS NOT NULL"), keys, n_classes, bars)
    return by_keys(several, found, keys, "left").select(*keys, F.when(enough, F.col("breaks")).alias("breaks"), reason.alias("reason"))


def bar_of(value: Column, edges: Column) -> Column:
    """How many of the sorted ``edges`` are at most the value, by halving."""
    low, high = F.lit(0), F.size(edges)
    # a step halves the places left: as many steps as the number of edges has bits
    steps = F.sequence(F.lit(1), F.length(F.bin(high)))
    middle = lambda s: ((s["low"] + s["high"]) / 2).cast("int")

    def halved(s: Column, _: Column) -> Column:
        open_, under = s["low"] < s["high"], F.get(edges, middle(s)) <= value
        return F.struct(
            F.when(open_ & under, middle(s) + 1).otherwise(s["low"]).alias("low"),
            F.when(open_ & ~under, middle(s)).otherwise(s["high"]).alias("high"),
        )

    return F.aggregate(steps, F.struct(low.alias("low"), high.alias("high")), halved, lambda s: s["low"])


def natural_breaks_by(data: DataFrame, keys: list[str], n_classes: int, bars: int) -> DataFrame:
    """``keys, breaks`` with the least squares within classes, for groups (keys, ``_x``).

    All groups are reduced to bars at once. A dynamic program cuts each group's
    bars (bounded in number, one small task a group); bars beside a cut are split for
    the groups that still need it, until these bars hold one value each.
    """
    head = data.groupBy(*keys).agg(
        F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.percentile_approx("_x", F.array(*[F.lit(i / bars) for i in range(1, bars)]), 8 * bars).alias("_marks")
    )
    equal = F.transform(F.sequence(F.lit(1), F.lit(bars - 1)), lambda i: F.col("_low") + (F.col("_high") - F.col("_low")) * i / bars)
    state = head.select(*keys, F.sort_array(F.array_distinct(F.concat("_marks", equal))).alias("_edges"), ((F.col("_low") + F.col("_high")) / 2).alias("_centre"))
    schema = f"{', '.join(f'`{k}` {data.schema[k].dataType.simpleString()}' for k in keys)}, _edges array<double>, _centre double, breaks array<double>"
    done = []
    while True:
        state = cut_lineage(state)
        met = by_keys(data, state, keys)
        gap = F.col("_x") - F.col("_centre")
        counted = met.groupBy(*keys, bar_of(F.col("_x"), F.col("_edges")).alias("_bar")).agg(
            F.count("*").alias("n"), F.sum(gap).alias("s"), F.sum(gap * gap).alias("q"), F.min("_x").alias("least"), F.max("_x").alias("most")
        )
        bar_rows = by_keys(counted, state, keys)

        def cut(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_bar")
            n, s, q, least, most = (group[c].to_numpy("float64") for c in ("n", "s", "q", "least", "most"))
            row = group.iloc[:1][[*keys, "_centre"]].copy()
            several = least < most
            if len(n) < n_classes:
                beside, breaks = np.flatnonzero(several), None
            else:
                cuts = _optimal_cuts(n, s, q, n_classes)
                near = {c + k for c in cuts[:-1] for k in (0, 1)}
                beside = np.array([i for i in sorted(near) if several[i]], dtype="int64")
                breaks = [*[float(most[c]) for c in cuts[:-1]], float(most[-1])] if not beside.size else None
            fresh = [np.linspace(least[i], most[i], SPLIT + 1)[1:] for i in beside]
            edges = sorted(set(group["_edges"].iloc[0]) | (set(np.concatenate(fresh).tolist()) if fresh else set()))
            row["_edges"], row["breaks"] = [edges], [breaks]
            return row[[*keys, "_edges", "_centre", "breaks"]]

        state = cut_lineage(bar_rows.groupBy(*keys).applyInPandas(cut, schema))
        done.append(state.where("breaks IS NOT NULL").select(*keys, "breaks"))
        state = state.where("breaks IS NULL").select(*keys, "_edges", "_centre")
        if not state.take(1):
            return functools.reduce(DataFrame.unionByName, done)


def classified_by(df: DataFrame, value: str, keys: Sequence[str], *, output: str = "class", **options) -> tuple[DataFrame, DataFrame]:
    """Every group's rows with their class, and the rejected groups with their reasons."""
    breaks = cut_lineage(breaks_by(df, value, keys, **options))
    met = by_keys(df, breaks.where("reason IS NULL").select(*keys, F.col("breaks").alias("_breaks")), keys)
    return met.withColumn(output, class_of(F.col(value), F.col("_breaks"))).drop("_breaks"), breaks.where("reason IS NOT NULL").select(*keys, "reason")
