"""Exact order statistics, ranks and samples that stay distributed.

``percentile`` keeps every distinct value of a group in one buffer and a rank
window sorts a whole group in one task. Neither is used: exact quantiles come from
histogram refinement and ranks from value buckets with offsets, at every size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.session import cut_lineage

BINS = 4096
#: Rows that the driver may read to end a refinement.
FEW = 4096
LEAST_BUCKETS = 8
MOST_BUCKETS = 4096
SALTS = 64


# --- quantiles -----------------------------------------------------------------


def column_stats(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> dict[str, tuple]:
    """(defined rows, minimum, maximum) of each column in one aggregation."""
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    parts = [
        F.struct(F.count(e).alias("n"), F.min(e).cast("double").alias("lo"), F.max(e).cast("double").alias("hi")).alias(f"s{i}")
        for i, e in enumerate(exprs.values())
    ]
    row = df.agg(*parts).first()
    return {n: (row[i]["n"], row[i]["lo"], row[i]["hi"]) for i, n in enumerate(exprs)}


def column_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    *,
    stats: Mapping[str, tuple] | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of each column over the non-null rows.

    Every pass is one scan that counts values per bin (map-side combined) and narrows the bin holding
    each wanted order statistic to the values it really contains, so no row is
    shuffled and the result is still exact. ``stats`` passes counts and ranges
    that are already known.
    """
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    names = list(exprs)
    data = df.select(*[exprs[n].cast("double").alias(n) for n in names])
    stats = stats or column_stats(data, names)
    counts = {n: stats[n][0] for n in names}
    wanted = {}
    for n in names:
        if counts[n]:
            for p in probs:
                position = p * (counts[n] - 1)
                for rank in (math.floor(position), math.ceil(position)):
                    wanted[(n, rank)] = (stats[n][1], stats[n][2], 0)
    found = _order_statistics(data, wanted)
    result = {}
    for n in names:
        values = []
        for p in probs:
            if not counts[n]:
                values.append(math.nan)
                continue
            position = p * (counts[n] - 1)
            base = math.floor(position)
            low, high = found[(n, base)], found[(n, math.ceil(position))]
            values.append(low + (high - low) * (position - base))
        result[n] = values
    return result


def _order_statistics(data: DataFrame, wanted: dict) -> dict:
    """Narrow (column, rank) -> (low, high, rows below low) until low equals high,
    or until so few rows are left that they can be read."""
    found, inside = {}, {}
    while wanted:
        for key in [k for k, (low, high, _) in wanted.items() if low == high]:
            found[key] = wanted.pop(key)[0]
        if not wanted:
            break
        intervals = sorted({(n, low, high) for (n, _), (low, high, _) in wanted.items()})
        if all(inside.get(i, FEW + 1) <= FEW // len(intervals) for i in intervals):
            found |= _read_off(data, wanted, intervals)
            break
        binned = []
        for i, (n, low, high) in enumerate(intervals):
            scaled = F.least(F.floor((F.col(n) - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")
            binned.append(
                F.when(
                    F.col(n).between(low, high),
                    F.struct(F.lit(i).alias("interval"), scaled.alias("bin"), F.col(n).alias("value")),
                )
            )
        rows = (
            data.select(F.explode(F.filter(F.array(*binned), lambda s: s.isNotNull())).alias("s"))
            .groupBy("s.interval", "s.bin")
            .agg(F.count("*").alias("n"), F.min("s.value").alias("low"), F.max("s.value").alias("high"))
            .orderBy("interval", "bin")
            .collect()
        )
        place = {interval: i for i, interval in enumerate(intervals)}
        of_interval: dict[int, list] = {}
        for row in rows:
            of_interval.setdefault(row["interval"], []).append(row)
        for (n, rank), (low, high, below) in list(wanted.items()):
            seen = below
            for row in of_interval[place[(n, low, high)]]:
                if seen + row["n"] > rank:
                    wanted[(n, rank)] = (row["low"], row["high"], seen)
                    inside[(n, row["low"], row["high"])] = row["n"]
                    break
                seen += row["n"]
    return found


def _read_off(data: DataFrame, wanted: dict, intervals: list[tuple]) -> dict:
    """The wanted ranks from the values of the last intervals, ``FEW`` at most."""
    kept = [F.when(F.col(n).between(low, high), F.struct(F.lit(i).alias("interval"), F.col(n).alias("value"))) for i, (n, low, high) in enumerate(intervals)]
    values: dict[int, list[float]] = {i: [] for i in range(len(intervals))}
    for row in data.select(F.explode(F.filter(F.array(*kept), lambda s: s.isNotNull())).alias("s")).select("s.*").collect():
        values[row["interval"]].append(row["value"])
    place = {interval: sorted(values[i]) for i, interval in enumerate(intervals)}
    return {(n, rank): place[(n, low, high)][rank - below] for (n, rank), (low, high, below) in wanted.items()}


# --- ranks ---------------------------------------------------------------------


class Marks:
    """Buckets of a column's values: about as many as partitions, so their number
    follows the cluster and not the rows. A value that fills several buckets on
    its own is singled out: its rank needs no order, so its rows may lie anywhere."""

    def __init__(self, marks: Sequence[float]):
        repeated = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
        # [v, next number) holds nothing but v
        self.splits = sorted({*marks, *(math.nextafter(v, math.inf) for v in repeated)})
        self.single = [float(i + 1) for i, v in enumerate(self.splits) if v in set(repeated)]

    @classmethod
    def measure(cls, rows: DataFrame, columns: Sequence[str], buckets: int) -> list["Marks"]:
        """Approximate marks suffice: they balance the work and never touch the result."""
        probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        found = rows.agg(*[F.percentile_approx(c, probs, 4 * buckets).alias(c) for c in columns]).first()
        return [cls(found[c] or []) for c in columns]

    def bucket(self, rows: DataFrame, column: str) -> DataFrame:
        if not self.splits:
            return rows.withColumn("_bucket", F.lit(0.0))
        splits = [-math.inf, *self.splits, math.inf]
        return Bucketizer(splits=splits, inputCol=column, outputCol="_bucket").transform(rows)


def with_rank(rows: DataFrame, value: str, groups: list[str], marks: Marks, source: DataFrame, spread_by: str, output: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` in its group, in one shuffle.

    Rows meet by bucket of values: equal values share one, so no tie crosses a
    border. Inside it a running sum orders them, and the rows of the
    buckets below (of ``source``, the same values) are one offset each. In a
    bucket of one value the mean rank follows from its count alone, so its rows
    are dealt out by ``spread_by``.
    """
    single = F.col("_bucket").isin(marks.single) if marks.single else F.lit(False)
    below = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marks.bucket(source.select(*groups, value), value)
        .groupBy(*groups, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(below), F.lit(0)))
        .withColumn("_deal", F.explode(F.when(single, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    )
    deal = F.when(single, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    by = [*groups, "_bucket", "_deal"]
    order = Window.partitionBy(*by).orderBy(value)
    upto = F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    inside = F.when(single, (F.col("_rows") + 1) / 2).otherwise(F.col("_upto") - (F.col("_ties") - 1) / 2)
    ranked = marks.bucket(rows, value).withColumn("_deal", deal).withColumns({"_upto": upto, "_ties": ties})
    other = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], "_rows", "_offset")
    equal = [F.col(c).eqNullSafe(F.col(f"_o{i}")) if c in groups else F.col(c) == F.col(f"_o{i}") for i, c in enumerate(by)]
    same = functools.reduce(lambda p, q: p & q, equal)
    ranked = ranked.join(other, same).drop(*[f"_o{i}" for i in range(len(by))])
    return ranked.withColumn(output, F.col("_offset") + inside).drop("_bucket", "_deal", "_rows", "_offset", "_upto", "_ties")


def significant(value: Column, digits: int) -> Column:
    """Value to so many significant digits, whatever its magnitude."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / size, digits - 1) * size)


def rank_pairs(df: DataFrame, x: str, y: str, *, groups: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """``groups, x, y`` of the rows with both values, to ``digits`` significant
    digits, so that summation-order noise cannot split ties."""
    rounded = lambda c: significant(F.col(c).cast("double"), digits)
    return df.select(*groups, rounded(x).alias("x"), rounded(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def ranked_correlation(rows: DataFrame, rx: str, ry: str, *, groups: Sequence[str] = (), min_n: int = 100) -> DataFrame:
    """``groups..., n, rho`` from the ranks on the rows."""
    a, b = F.col(rx), F.col(ry)
    sums = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return sums.select(*groups, "n", F.when((F.col("n") >= min_n) & (vx > 0) & (vy > 0), rho).alias("rho"))


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    return buckets or min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS), MOST_BUCKETS)


def stored_spearman(rows: DataFrame, *, groups: Sequence[str] = (), min_n: int = 100, buckets: int | None = None) -> DataFrame:
    """Rank correlation of stored rows of ``rank_pairs``, which are read four times.

    The rank of ``x`` travels on the row to the buckets of ``y``, where the sums
    are taken: two shuffles of the rows, and none joins a table of values.
    """
    groups = list(groups)
    marks_x, marks_y = Marks.measure(rows, ["x", "y"], bucket_count(rows, buckets))
    with_x = with_rank(rows, "x", groups, marks_x, rows, "y", "_rx").drop("x")
    both = with_rank(with_x, "y", groups, marks_y, rows, "_rx", "_ry")
    return ranked_correlation(both, "_rx", "_ry", groups=groups, min_n=min_n)


def spearman(df: DataFrame, x: str, y: str, *, groups: Sequence[str] = (), min_n: int = 100, buckets: int | None = None, digits: int = 12) -> DataFrame:
    """Rank correlation with average ranks over all jointly defined rows.

    Returns ``groups..., n, rho``; ``rho`` is null below ``min_n`` rows or
    where a side is constant.
    """
    rows = cut_lineage(rank_pairs(df, x, y, groups=groups, digits=digits))
    return stored_spearman(rows, groups=groups, min_n=min_n, buckets=buckets)


# --- samples and lookups -------------------------------------------------------


def hash_sample(
    df: DataFrame, groups: Sequence[str], size: int | Column, keys: Sequence[str], *, seed: int = 0, order: Column | None = None
) -> DataFrame:
    """``size`` rows per group in the order of a seeded key hash (all rows if fewer).

    Reproducible under re-execution. The hash of the last wanted row is an order
    statistic of its group, found by refinement like any other; rows below it are
    kept by a filter, and only rows equal to it are ranked. ``order`` replaces the
    hash by another number (whole and below 2^53), such as one that other engines compute.
    """
    from aridscape.operators.keyed import by_keys, order_statistics

    groups = list(groups)
    whole = F.xxhash64(*keys, F.lit(seed))
    place = F.shiftrightunsigned(whole, 11) if order is None else order
    limit = size if isinstance(size, Column) else F.lit(size)
    marked = df.withColumns({"_h": whole, "_place": place.cast("double")})
    data = cut_lineage(marked.select(*groups, F.array("_place").alias("_v"), limit.cast("long").alias("_limit")))
    counts = data.groupBy(*groups).agg(F.count("*").alias("_inside"), F.min(F.col("_v")[0]).alias("_low"), F.max(F.col("_v")[0]).alias("_high"), F.max("_limit").alias("_limit"))
    counts = cut_lineage(counts)
    larger = counts.where("_inside > _limit AND _limit > 0")
    wanted = larger.select(*groups, F.lit(0).alias("_c"), (F.col("_limit") - 1).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"), "_inside")
    cuts = order_statistics(data.drop("_limit"), wanted, groups).select(*groups, F.col("_value").alias("_cut"))
    cuts = cut_lineage(by_keys(counts.select(*groups, "_inside", "_limit"), cuts, groups, "left"))
    below = by_keys(data, cuts.select(*groups, "_cut"), groups).where(F.col("_v")[0] < F.col("_cut")).groupBy(*groups).agg(F.count("*").alias("_below"))
    cuts = by_keys(cuts, below, groups, "left")
    met = by_keys(marked, cuts, groups).where("_limit > 0 AND (_inside <= _limit OR _place <= _cut)")
    sure = (F.col("_inside") <= F.col("_limit")) | (F.col("_place") < F.col("_cut"))
    within = Window.partitionBy(*groups).orderBy("_h", *keys)
    equal = met.where(~sure).withColumn("_turn", F.row_number().over(within)).where(F.col("_turn") <= F.col("_limit") - F.coalesce("_below", F.lit(0))).drop("_turn")
    return met.where(sure).unionByName(equal).drop("_h", "_place", "_inside", "_limit", "_cut", "_below")
