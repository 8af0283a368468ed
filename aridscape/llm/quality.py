"""Quality rules: fixed limits, then robust multivariate outliers.

Every document becomes a vector of transformed text statistics. For each
language and source a minimum-covariance-determinant estimate (centre and
covariance of the most central rows) is found by concentration steps over all
rows; documents whose Mahalanobis distance is beyond the limit are rejected.

Defined results: null text counts as empty; null language or source form groups
of their own; a null ``doc_id`` is carried along; repeated rows are judged one by
one and alike; an empty table gives no rows; other columns, whatever their names,
are left out by ``judged`` and kept by ``filtered``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aridscape.llm.common import boxed, written
from aridscape.llm.words import mixed, slices, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars_all", "n_upper", "n_punct", "n_distinct", "n_lines"]
KEYS = ["doc_id", "lang", "source", "text_hash"]
FEATURES = ["f_length", "f_word", "f_symbol", "f_upper", "f_punct", "f_distinct"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every row of a text column, over whole texts."""
    parts: dict[str, list] = {k: [] for k in COUNTS + EXTRA}
    for s in slices(column):
        rows, add = s.rows, lambda k, v: parts[k].append(v.astype(np.int64))
        points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80, dtype=np.int64)])
        add("n_words", np.diff(s.bounds))
        add("word_chars", np.bincount(s.row, points[s.ends] - points[s.starts], rows))
        add("n_chars_all", points[s.offsets[1:]] - points[s.offsets[:-1]])
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_punct", _PUNCT)):
            add(name, _per_row(table[s.data], s.offsets))
        salt = mixed(np.arange(rows, dtype=np.uint64) + np.uint64(1))
        hashes = s.hashes()
        add("n_distinct", np.bincount(s.row[np.unique(hashes ^ salt[s.row], return_index=True)[1]], minlength=rows))

        # lines that hold a word; a line ends at \n or with its text
        breaks = np.flatnonzero(s.data == 10)
        begin = np.union1d(s.offsets[:-1], breaks + 1)
        begin = begin[begin < len(s.data)]
        line_row = np.searchsorted(s.offsets, begin, "right") - 1
        stop = np.append(breaks, len(s.data))[np.searchsorted(breaks, begin)]
        stop = np.minimum(stop, s.offsets[line_row + 1])
        held = np.searchsorted(s.starts, stop) > np.searchsorted(s.starts, begin)
        begin, stop, line_row = begin[held], stop[held], line_row[held]
        lines = np.bincount(line_row, minlength=rows)
        first = np.unique(s.hashes(begin, stop) ^ salt[line_row], return_index=True)[1]
        add("n_lines", lines)
        add("n_dup_lines", lines - np.bincount(line_row[first], minlength=rows))

        at, window = windows(hashes, s.row, 8)
        if len(at):
            _, inverse, count = np.unique(window ^ salt[s.row[at]], return_inverse=True, return_counts=True)
            twice = at[count[inverse] > 1]
            edge = np.bincount(twice, minlength=len(hashes) + 8) - np.bincount(twice + 8, minlength=len(hashes) + 8)
            covered = np.cumsum(edge)[: len(hashes)] > 0
            add("n_repeat_words", np.bincount(s.row[covered], minlength=rows))
        else:
            add("n_repeat_words", np.zeros(rows))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def statistics_table(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, text_hash`` and all counts, one row per document."""
    names = COUNTS + EXTRA

    def run(batches):
        for batch in batches:
            stats = text_statistics(batch.column("text"))
            keys = [batch.column(k) for k in KEYS]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(stats[k]) for k in names], [*KEYS, *names])

    kinds = {k: docs.schema[k].dataType.simpleString() for k in ("doc_id", "lang", "source")}
    schema = ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in KEYS) + "".join(f", {k} bigint" for k in names)
    keyed = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, schema)


def with_features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: logarithms of length and word length, variance-
    stabilised shares, and distinct words against what the length lets expect."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return stats.select(
        "*",
        F.log(words).alias("f_length"),
        F.log((F.col("word_chars") + 1) / words).alias("f_word"),
        F.sqrt(F.col("n_symbols") / chars).alias("f_symbol"),
        F.sqrt(F.col("n_upper") / chars).alias("f_upper"),
        F.sqrt(F.col("n_punct") / chars).alias("f_punct"),
        (F.log((F.col("n_distinct") + 1) / (words + 1))).alias("f_distinct"),
    )


def chi_square_quantile(q: float, p: int) -> float:
    """Quantile by the cube-root normal approximation."""
    c = 2 / (9 * p)
    return p * (1 - c + NormalDist().inv_cdf(q) * math.sqrt(c)) ** 3


def distance_limit(n: F.Column, share: float, p: int) -> F.Column:
    """Limit of the squared distance under an estimate from ``n`` rows that a
    ``share`` of regular rows exceeds: a quantile of Hotelling's T-squared (the F
    quantile by the cube-root normal approximation). It falls to the chi-square
    quantile as rows grow and is null where so few rows exclude no distance."""
    z = NormalDist().inv_cdf(1 - share)
    a, free = 2 / (9 * p), F.greatest(n - p, F.lit(1)).cast("double")
    b = F.lit(2 / 9) / free
    square = (1 - b) * (1 - b) - z * z * b
    half = (1 - b) * (1 - a)
    root = (half + F.sqrt(F.greatest(half * half - square * ((1 - a) ** 2 - z * z * a), F.lit(0.0)))) / square
    return F.when((n > p) & (square > 0), F.pow(root, F.lit(3.0)) * p * (n - 1) * (n + 1) / (n * free))


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
#: Least standard deviations, so that a statistic that is constant in a group does not reject by a single character.
FLOOR = [0.25, 0.05, 0.03, 0.04, 0.04, 0.06]


def _distance() -> F.Column:
    """Squared Mahalanobis distance under the group's ``centre`` and ``inverse``."""
    d = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * F.col("inverse")[k] * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def _bin(value, fine: int = 64):
    return F.floor(F.log2(value + F.lit(1e-9)) * fine).cast("long")


def _order_bin(binned: DataFrame, share: float, *keys: str) -> DataFrame:
    """Per key (``grp`` and more), the bin of ``b`` in which the smallest ``share`` of the rows ends."""
    keys = ("grp", *keys)
    counts = binned.groupBy(*keys, "b").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys)
    return (
        counts.select(*keys, "b", F.sum("c").over(whole.orderBy("b")).alias("upto"), F.sum("c").over(whole).alias("total"))
        .where(F.col("upto") >= F.ceil(F.col("total") * share))
        .groupBy(*keys)
        .agg(F.min("b").alias("cut"))
    )


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre and inverse covariance per group from its sums (a small matrix each)."""
    p = len(FEATURES)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pydict()
            centres, inverses = [], []
            for g in range(batch.num_rows):
                n = max(pdf["n"][g], 1)
                mean = np.array([pdf[f"s{i}"][g] for i in range(p)]) / n
                cov = np.zeros((p, p))
                for k, (i, j) in enumerate(PAIRS):
                    cov[i, j] = cov[j, i] = pdf[f"q{k}"][g] / n - mean[i] * mean[j]
                cov += np.diag(np.square(FLOOR))
                inverse = np.linalg.inv(cov)
                centres.append(mean.tolist())
                inverses.append([inverse[i, j] for i, j in PAIRS])
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(centres, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], ["grp", "centre", "inverse"])

    return moments.mapInArrow(run, "grp string, centre array<double>, inverse array<double>")


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    squares = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{k}") for k, (i, j) in enumerate(PAIRS)]
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *sums, *squares)


def covariance_estimates(rows: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """``grp, centre, inverse, scale``: minimum-covariance-determinant estimates.

    ``rows`` holds ``grp`` and the features. The start is the covariance of the
    rows nearest to the coordinate-wise medians. Each concentration step keeps
    the ``share`` of a group's rows with the smallest distances (up to the width
    of a 1/64-octave bin) and re-estimates from them; determinants never grow.
    ``scale`` makes the median distance that of a chi-square variable.
    """
    p = len(FEATURES)
    binned = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(f) * 256).cast("long") for f in FEATURES])).alias("feature", "b"))
    medians = _order_bin(binned, 0.5, "feature").groupBy("grp")
    start = medians.agg(F.sort_array(F.collect_list(F.struct("feature", F.col("cut") / 256))).alias("m")).select(
        "grp",
        F.transform("m", lambda x: x["col2"]).alias("centre"),
        F.array(*[F.lit(1.0 / FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS]).alias("inverse"),
    )
    estimates = written(start, "mcd")
    for _ in range(steps):
        near = rows.join(estimates, "grp").withColumn("b", _bin(_distance()))
        cut = _order_bin(near.select("grp", "b"), share)
        kept = near.join(cut, "grp").where("b <= cut")
        estimates = written(_estimates(_moments(kept)), "mcd")
    near = rows.join(estimates, "grp").select("grp", _bin(_distance()).alias("b"))
    middle = _order_bin(near, 0.5).select("grp", F.pow(F.lit(2.0), (F.col("cut") + 0.5) / 64).alias("middle"))
    scaled = F.greatest(F.col("middle") / chi_square_quantile(0.5, p), F.lit(1.0))
    return written(estimates.join(middle, "grp").select("grp", "centre", "inverse", scaled.alias("scale")), "mcd")


def judged(docs: DataFrame, min_rows: int = 200, outlier_share: float = 1e-9) -> DataFrame:
    """``doc_id, lang, source``, counts, ``base_failed``, ``distance`` and ``kept`` per document.

    Groups are language and source; one with fewer than ``min_rows`` rows is
    judged with the other small groups of its language, and languages that are
    still small together; if those are too few as well, by the estimate of all
    rows. ``outlier_share`` is the share of regular documents that the distance
    limit may reject; the limit is wider the fewer rows an estimate rests on.
    """
    stats = with_features(statistics_table(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "statistics")
    passed = stats.where("NOT base_failed")

    def label(column: str):
        return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))

    fine = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    coarse = fine.withColumn("small", F.when(F.col("n") < min_rows, 1).otherwise(0))
    by_lang = coarse.where("small = 1").groupBy("lang").agg(F.sum("n").alias("lang_n"))
    groups = (
        coarse.join(by_lang.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left")
        .select(
            F.col("lang").alias("g_lang"),
            F.col("source").alias("g_source"),
            F.when(F.col("small") == 0, F.concat(label("lang"), F.lit("\x01"), label("source")))
            .when(F.col("lang_n") >= min_rows, label("lang"))
            .otherwise(F.lit("all"))
            .alias("grp"),
            F.col("n").alias("g_rows"),
        )
    )
    groups = written(groups, "groups")
    joined = stats.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source", "g_rows")
    regular = joined.where("NOT base_failed")
    last = groups.where("grp = 'all'").agg(F.sum("g_rows")).first()[0]
    judges = regular.select("grp", *FEATURES)
    if last and last < min_rows:
        judges = judges.union(regular.where("grp <> 'all'").select(F.lit("all"), *FEATURES))
    sizes = judges.groupBy("grp").agg(F.count("*").alias("members"))
    estimates = covariance_estimates(judges).join(sizes, "grp")
    estimates = estimates.withColumn("limit", distance_limit(F.col("members"), outlier_share, len(FEATURES))).drop("members")
    out = joined.join(estimates, "grp", "left").withColumn("distance", _distance() / F.col("scale"))
    far = F.coalesce(F.col("distance") > F.col("limit"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    return out.drop("centre", "inverse", "scale", "limit", *EXTRA)


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns.

    A verdict depends on the text, language and source alone, so rows join their
    verdict by ``doc_id`` and, for repeated or null ids, by the text's hash.
    """
    verdicts = judged(docs, **options).where("kept").select(
        F.col("doc_id").alias("v_id"), F.col("lang").alias("v_lang"), F.col("source").alias("v_source"), F.col("text_hash").alias("v_hash")
    ).distinct()
    rows = boxed(docs, k_id=F.col("doc_id"), k_lang=F.col("lang"), k_source=F.col("source"), k_hash=F.xxhash64("text"))
    same = [F.col(f"k_{k}").eqNullSafe(F.col(f"v_{k}")) for k in ("id", "lang", "source")]
    return rows.join(verdicts, [*same, F.col("k_hash") == F.col("v_hash")], "left_semi").select("row.*")
