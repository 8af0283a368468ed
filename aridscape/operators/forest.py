"""Regression forests over binned rows, each tree grown from its own draw of all rows."""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are summarised or packed together.
CHUNK = 1 << 18
#: Runs by which a chunk tells how its values spread.
RUNS = 1024
#: Bin of a leaf: no value lies beyond it, so a walk stays where it is.
STAY = 255


# --- bins -------------------------------------------------------------------------


def value_runs(values: np.ndarray, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """(value, rows) of all distinct values, or, if there are more, of ``runs`` runs of equal
    length in their order, each under its largest value."""
    ordered = np.sort(values)
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    if len(last) > runs:
        last = np.arange(1, runs + 1) * len(ordered) // runs - 1
    return ordered[last], np.diff(last, prepend=-1)


def bin_edges(values: np.ndarray, rows: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of some equal numbers of rows, or between all values where they are few."""
    distinct, where = np.unique(values, return_inverse=True)
    if len(distinct) <= bins:
        at = np.arange(len(distinct) - 1)
    else:
        upto = np.cumsum(np.bincount(where, rows))
        at = np.unique(np.searchsorted(upto, np.arange(1, bins) * upto[-1] / bins))
        at = at[at < len(distinct) - 1]
    middle = distinct[at] + (distinct[at + 1] - distinct[at]) / 2
    return np.where(middle < distinct[at + 1], middle, distinct[at])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def measure_bins(points: DataFrame, bins: int) -> tuple[list[np.ndarray], int]:
    """(edges of every feature, rows): one pass over all rows. An edge is off its rank by a run
    of each chunk at most, one row in ``RUNS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            values = _matrix(table.column(0).chunk(0), len(table.column(0)[0]))
            told = [value_runs(values[:, f]) for f in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(told)), pa.int32()), pa.array([v.tobytes() for v, _ in told]), pa.array([n.astype(np.int64).tobytes() for _, n in told])],
                ["feature", "value", "rows"],
            )

    told: dict[int, list] = {}
    for r in points.select(vector_to_array("features")).mapInArrow(run, "feature int, value binary, rows binary").collect():
        told.setdefault(r["feature"], []).append((np.frombuffer(r["value"]), np.frombuffer(r["rows"], np.int64)))
    if not told:
        raise ValueError("no rows to fit a forest on")
    spread = [tuple(np.concatenate(part) for part in zip(*told[f])) for f in range(len(told))]
    return [bin_edges(v, n, bins) for v, n in spread], int(spread[0][1].sum())


def bin_codes(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)


def _code_column(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def group_rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first place of each group in it) that puts rows of equal codes side by side."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    padded[:, : codes.shape[1]] = codes
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    return order, np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(1)))


def packed_rows(points: DataFrame, edges: Sequence[np.ndarray], rows: int) -> DataFrame:
    """All rows with bins for values, rows of equal bins together, packed some ``CHUNK`` in one."""
    width = len(edges)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bin_codes(_matrix(batch.column(0), width), edges)
            yield pa.RecordBatch.from_arrays([_code_column(codes), *batch.columns[1:]], ["code", "key", "label", "weight"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            codes = _codes(table.column("code").chunk(0), width)
            order, starts = group_rows(codes)
            key, label, weight = (table.column(c).to_numpy()[order] for c in ("key", "label", "weight"))
            same = weight[0] if (weight == weight[0]).all() else weight
            parts = (codes[order[starts]], starts.astype(np.int32), key.view(np.uint64), label, same)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts, 5)], pa.binary())], ["part"])

    parallel = points.sparkSession.sparkContext.defaultParallelism
    coded = points.select(vector_to_array("features"), F.col("key").cast("long"), F.col("label").cast("double"), F.col("weight").cast("double"))
    coded = coded.mapInArrow(code, "code binary, key long, label double, weight double")
    return coded.repartition(max(parallel, -(-rows // CHUNK)), "code").mapInArrow(pack, "part binary")


# --- trees ------------------------------------------------------------------------


def draw_table(share: float) -> np.ndarray:
    """How often a row is drawn (Poisson with mean ``share``), by sixteen random bits."""
    chance, upto = np.exp(-share), []
    for k in range(1, 40):
        upto.append(chance)
        chance *= share / k
    return np.searchsorted(np.cumsum(upto), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float64)


def draw_rows(key: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    """How often the tree draws each row: told by the row's key, wherever the row lies."""
    first, second = np.random.SeedSequence([seed, tree]).generate_state(2, np.uint64) | np.uint64(1)
    mixed = key * first
    mixed ^= mixed >> np.uint64(32)
    mixed *= second
    return table[mixed >> np.uint64(48)]


def _running(values: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with every owner."""
    upto = np.cumsum(values)
    return upto - (upto[starts] - values[starts])[owner]


def grow_tree(codes: np.ndarray, n: np.ndarray, w: np.ndarray, wy: np.ndarray, sizes: Sequence[int], *, depth: int, min_leaf: int) -> tuple[np.ndarray, ...]:
    """(feature, bin, left child, value of every node; importances) of the tree over groups of rows.

    ``n``, ``w`` and ``wy`` are each group's drawn rows, weight and weighted sum of labels.
    Nodes are split level by level where that lowers the squared error most; values up to the
    bin go left, the right child follows the left one, and a leaf is its own child.
    """
    cols, mean = np.ascontiguousarray(codes.T), wy.sum() / w.sum()
    wy = wy - mean * w
    node = np.zeros(len(n), np.int64)
    tn, tw, ty = (np.array([part.sum()]) for part in (n, w, wy))
    out, importance, base = [], np.zeros(len(sizes)), 0
    for level in range(depth + 1):
        count = len(tn)
        feature, cut = np.zeros(count, np.int8), np.full(count, STAY, np.uint8)
        left, child = base + np.arange(count, dtype=np.int32), None
        may = tn >= 2 * min_leaf
        if level < depth and may.any():
            wide = np.flatnonzero(may)
            inside = may[node]
            if not inside.all():
                cols, n, w, wy, node = cols[:, inside], n[inside], w[inside], wy[inside], node[inside]
            place = (np.cumsum(may) - 1)[node]
            before = ty[wide] ** 2 / tw[wide]
            best, pick = 1e-12 * before, np.zeros((3, len(wide)))
            for f, size in enumerate(sizes):
                if size < 2:
                    continue
                at = place * size + cols[f]
                counts, *sums = (np.bincount(at, part, len(wide) * size) for part in (n, w, wy))
                met = np.flatnonzero(counts)  # only bins with rows end a left side
                owner = met // size
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                ln, lw, ly = (_running(part[met], starts, owner) for part in (counts, *sums))
                rn, rw, ry = tn[wide][owner] - ln, tw[wide][owner] - lw, ty[wide][owner] - ly
                sound = (ln >= min_leaf) & (rn >= min_leaf) & (lw > 0) & (rw > 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(sound, ly * ly / lw + ry * ry / rw - before[owner], -np.inf)
                most = np.maximum.reduceat(gain, starts)
                hit = np.flatnonzero(gain == most[owner])[::-1]
                first = np.zeros(len(wide), np.int64)
                first[owner[hit]] = hit
                won = most > best
                best[won], at = most[won], first[won]
                feature[wide[won]], cut[wide[won]] = f, met[at] % size
                pick[:, won] = ln[at], lw[at], ly[at]
            split = cut[wide] != STAY
            if split.any():
                np.add.at(importance, feature[wide[split]], best[split])
                left[wide[split]] = base + count + 2 * np.arange(split.sum())
                parts = pick[:, split]
                child = [np.stack([part, whole[wide[split]] - part], 1).ravel() for part, whole in zip(parts, (tn, tw, ty))]
        out.append((feature, cut, left, mean + ty / tw))
        if child is None:
            break
        goes = cut[node] != STAY
        if not goes.all():
            cols, n, w, wy, node = cols[:, goes], n[goes], w[goes], wy[goes], node[goes]
        beyond = cols[feature[node], np.arange(len(node))] > cut[node]
        node = left[node] - (base + count) + beyond
        base += count
        tn, tw, ty = child
    total = importance.sum()
    return (*(np.concatenate(part) for part in zip(*out)), importance / total if total else importance)


def _grown(packed: Iterator[bytes], *, tree: int, seed: int, share: float, sizes: Sequence[int], depth: int, min_leaf: int) -> Iterator[tuple]:
    table, parts = draw_table(share), []
    for part in packed:
        codes, starts, key, label, weight = pickle.loads(part)
        drawn = draw_rows(key, tree, seed, table)
        n, w, wy = (np.add.reduceat(part, starts) for part in (drawn, drawn * weight, drawn * weight * label))
        met = n > 0
        parts.append((codes[met], n[met], w[met], wy[met]))
    codes, *sums = (np.concatenate(part) for part in zip(*parts))
    if not len(codes):
        return  # a tree that drew nothing says nothing
    order, starts = group_rows(codes)
    sums = [np.add.reduceat(part[order], starts) for part in sums]
    grown = grow_tree(codes[order[starts]], *sums, sizes, depth=depth, min_leaf=min_leaf)
    yield (tree, *(bytearray(part.tobytes()) for part in grown))


# --- forest -----------------------------------------------------------------------

_TYPES = (np.int8, np.uint8, np.int32, np.float64)
_STORED = "uid string, edges array<array<double>>, tree int, feature binary, bin binary, left binary, value binary, importance binary"


def walk(trees: Sequence[tuple], codes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Mean over the trees of the value that each row of bins ends at."""
    out = np.zeros(len(codes))
    for start in range(0, len(codes), step):
        part = codes[start : start + step]
        flat, row = np.ascontiguousarray(part.T).ravel(), np.arange(len(part))
        total = np.zeros(len(part))
        for feature, cut, left, value, *_ in trees:
            node = np.zeros(len(part), np.int32)
            while True:
                after = left[node] + (flat[feature[node].astype(np.int64) * len(part) + row] > cut[node])
                if (after == node).all():
                    break
                node = after
            total += value[node]
        out[start : start + step] = total / len(trees)
    return out


class RandomForestRegressionModel:
    """Trees as arrays; ``transform`` adds ``prediction`` to rows with ``features``."""

    def __init__(self, uid: str, edges: Sequence[np.ndarray], trees: Sequence[tuple]):
        self.uid, self.edges, self.trees = uid, [np.asarray(e, float) for e in edges], list(trees)

    @property
    def importances(self) -> np.ndarray:
        """Share of each feature in what the splits gain, averaged over trees."""
        mean = np.mean([t[4] for t in self.trees], axis=0)
        return mean / mean.sum() if mean.sum() else mean

    def save(self, spark: SparkSession, path: str) -> None:
        edges = [e.tolist() for e in self.edges]
        rows = [(self.uid, edges, i, *(bytearray(part.tobytes()) for part in t)) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, _STORED).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RandomForestRegressionModel:
        rows = spark.read.parquet(path).orderBy("tree").collect()
        return RandomForestRegressionModel(rows[0]["uid"], rows[0]["edges"], [_tree(r[3:]) for r in rows])

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows of equal bins end at the same leaves, so each vector of bins is walked once."""
        context, edges, width = df.sparkSession.sparkContext, self.edges, len(self.edges)
        shared = context.broadcast([t[:4] for t in self.trees])

        @F.arrow_udf("binary")
        def coded(features: pa.Array) -> pa.Array:
            return _code_column(bin_codes(_matrix(features, width), edges))

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in chunks(batches):
                codes = table.column(0).chunk(0)
                yield pa.RecordBatch.from_arrays([codes, pa.array(walk(shared.value, _codes(codes, width)))], ["_code", "prediction"])

        rows = df.withColumn("_code", coded(vector_to_array("features")))
        met = rows.select("_code").repartition(context.defaultParallelism, "_code").distinct()
        return rows.join(met.mapInArrow(predict, "_code binary, prediction double"), "_code").drop("_code")


def _tree(parts: Sequence) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes(part), kind) for part, kind in zip(parts, (*_TYPES, np.float64)))


@dataclass(frozen=True)
class RandomForestRegressor:
    """Every tree draws rows with replacement, ``share`` of all in the mean, and every split
    looks at all features, whose values fall into ``bins`` bins."""

    trees: int = 100
    depth: int = 15
    min_leaf: int = 5
    bins: int = 64
    share: float = 1.0
    seed: int = 42

    def fit(self, points: DataFrame) -> RandomForestRegressionModel:
        """Forest over all rows of ``features, label, weight, key``.

        Two passes bin and pack the rows; then one task grows each tree. It reads all packed
        rows once and keeps sums by vector of bins: at most a row's worth for every vector met.
        """
        context = points.sparkSession.sparkContext
        edges, rows = measure_bins(points, self.bins)
        # kept as Python wrote them: every tree reads them, and the JVM is slow to pickle bytes
        packed = packed_rows(points, edges, rows).rdd.map(lambda row: bytes(row["part"])).persist(StorageLevel.DISK_ONLY)
        packed.count()  # packed by all tasks, not by the first tree's
        options = dict(seed=self.seed, share=self.share, sizes=[len(e) + 1 for e in edges], depth=self.depth, min_leaf=self.min_leaf)
        whole = packed.coalesce(1)
        grown = context.union([whole.mapPartitions(functools.partial(_grown, tree=t, **options)) for t in range(self.trees)]).collect()
        packed.unpersist()
        if not grown:
            raise ValueError("no tree drew a row")
        return RandomForestRegressionModel(f"forest_{uuid.uuid4().hex}", edges, [_tree(parts[1:]) for parts in sorted(grown, key=lambda g: g[0])])
