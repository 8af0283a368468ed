"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where more than half of the document's shingle
hashes have it set. Distinct fingerprints are laid into tiles by the population
counts of their four 16-bit parts. Two fingerprints within ``radius`` bits differ
by at most ``radius`` in the sum of those counts' differences, so tile pairs
beyond it are skipped; every other pair of tiles is compared in full with numpy
exclusive-or and bit counts. Nothing is sampled and no pair is missed.

Defined results: null text counts as empty; a document without words has the
fingerprint zero and links like any other; repeated rows and repeated ids are
kept; a null ``doc_id`` takes part but never names a component (a component
without any id has a null one); an empty table gives no rows; other columns are
ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.llm.common import boxed, components, written
from aridscape.llm.words import mixed

SEED = 42
TILE = 4096
SET_TILE = 256


def _shingle_hashes(data: bytes, width: int) -> np.ndarray:
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n - width + 1)


def _majority(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(data: bytes, width: int = 3) -> int:
    """Fingerprint of one UTF-8 text as an unsigned integer."""
    return int(_majority(_shingle_hashes(data, width)))


def wide_fingerprint(data: bytes, width: int = 5, parts: int = 4) -> np.ndarray:
    """``parts`` fingerprints of the text's distinct shingles under independent hashes."""
    return _wide(np.unique(_shingle_hashes(data, width)), parts)


def _wide(hashes: np.ndarray, parts: int = 4) -> np.ndarray:
    return np.array([_majority(hashes if k == 0 else mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))) for k in range(parts)], np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint (as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            prints = np.fromiter((fingerprint(x.encode(), width) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from every linked node to the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if np.array_equal(low, label[i]) and np.array_equal(low, label[j]):
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, more=None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the rows of ``a`` and ``b`` (numbered after ``a``;
    the same rows if ``same``) that differ in at most ``radius`` bits.

    ``more`` holds further fingerprints of the rows of either side; then all
    bits together must differ in at most ``limit`` places.
    """
    n, shift = (len(a), 0) if same else (len(a) + len(b), len(a))
    label = np.arange(n)
    step = max(1, (1 << 20) // max(len(b), 1))
    for at in range(0, len(a), step):
        gap = np.bitwise_count(a[at : at + step, None] ^ b[None, :])
        i, j = np.nonzero(gap <= radius)
        if more is not None:
            total = gap[i, j].astype(np.int64) + np.bitwise_count(more[0][i + at] ^ more[1][j]).sum(axis=1, dtype=np.int64)
            i, j = i[total <= limit], j[total <= limit]
        i, j = label[i + at], label[j + shift]
        if len(i):
            member, root = _forest(i, j, n)
            moved = np.arange(n)
            moved[member] = root
            label = moved[label]
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _count(part: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * part).bitwiseAND(F.lit(0xFFFF)))


def tile_pairs(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``same, a, b``: the rows (arrays of structs) of every pair of tiles that
    may hold close fingerprints.

    ``nodes`` holds ``fp`` and what goes with it. Rows with equal population
    counts in every part of ``fp`` form a cell; fuller ones are split by a hash
    into tiles of about ``tile`` rows. A wide radius skips few cells, so its
    cells are kept large: four parts up to radius 3, two up to 8, one beyond.
    """
    parts = 4 if radius <= 3 else 2 if radius <= 8 else 1
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    keys = [f"p{k}" for k in range(parts)]
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(mask)).alias(keys[k]) for k in range(parts)]
    marked = nodes.select(F.struct(*nodes.columns).alias("node"), "fp", *counts)
    sizes = marked.groupBy(*keys).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    spread = marked.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = written(spread.groupBy(*keys, "part").agg(F.collect_list("node").alias("rows")), "tiles")
    cell = sum(F.col(k).cast("long") * 65 ** (parts - 1 - i) for i, k in enumerate(keys))
    near = [o for o in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius and o >= (0,) * parts]
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in near])
    left = tiles.select(*keys, F.col("part").alias("part_a"), F.explode(offsets).alias("o"))
    left = left.select(cell.alias("cell_a"), "part_a", *[(F.col(k) + F.col("o")[i]).alias(k) for i, k in enumerate(keys)])
    right = tiles.select(*keys, cell.alias("cell_b"), F.col("part").alias("part_b"))
    pairs = left.join(right, keys).where("cell_a <> cell_b OR part_a <= part_b").drop(*keys)
    full = tiles.select(cell.alias("cell"), "part", "rows")
    a = full.select(F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("rows").alias("a"))
    b = full.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("rows").alias("b"))
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))
    return pairs.join(a, ["cell_a", "part_a"]).join(b, ["cell_b", "part_b"]).select(same.alias("same"), "a", "b")


def links(nodes: DataFrame, radius: int, limit: int = 0) -> DataFrame:
    """``u, v``: links between close ``node`` values, as many per tile pair as
    keep what is connected connected.

    ``nodes`` holds ``node`` and ``fp`` and, if ``limit`` is given, an array
    ``more`` of further fingerprints that must agree within ``limit`` bits.
    """

    def column(values, name):
        return values.values.field(name).to_numpy(zero_copy_only=False)

    def wide(values):
        return np.stack(values.values.field("more").to_numpy(zero_copy_only=False)).view(np.uint64)

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for same, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                more = (wide(a), wide(b)) if limit else None
                member, root = tile_forest(column(a, "fp").view(np.uint64), column(b, "fp").view(np.uint64), radius, same, more, limit)
                if len(member):
                    node = column(a, "node") if same else np.concatenate([column(a, "node"), column(b, "node")])
                    us.append(node[member])
                    vs.append(node[root])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return tile_pairs(nodes, radius).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: the component of each document under links of
    at most ``radius`` differing bits, named by its smallest ``doc_id``."""
    prints = written(fingerprints(docs, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    joined = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius)).withColumnRenamed("node", "fp")
    labelled = distinct.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def similar_sets(a: list[np.ndarray], b: list[np.ndarray], same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, numbered as in ``tile_forest``, of the sets (distinct
    hashes) whose Jaccard similarity is at least ``similarity``."""
    shift = 0 if same else len(a)
    sizes = np.array([len(x) for x in b], np.int64)
    hashes = np.concatenate(b)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(b)), sizes)[order]
    us, vs = [], []
    for i, x in enumerate(a):
        lo, n = np.searchsorted(hashes, x), np.searchsorted(hashes, x, "right")
        n -= lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(b))
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (len(x) + sizes - shared) - 1e-9))
        us.append(np.full(len(near), i))
        vs.append(near + shift)
    return _forest(np.concatenate(us), np.concatenate(vs), len(a) + (0 if same else len(b)))


def exact_links(members: DataFrame, sets: DataFrame, similarity: float, tile: int = SET_TILE) -> DataFrame:
    """``u, v``: spanning links of the nodes of one ``key`` whose sets reach the similarity.

    ``members`` holds ``key, node`` and ``sets`` holds ``node, shingles``. All pairs
    of a key are compared; a key with many nodes is split into tiles, of which
    all pairs are compared.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = members.join(sizes, "key").join(sets, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = written(tiled.groupBy("key", "tile", "tiles").agg(F.collect_list(F.struct("node", "shingles")).alias("rows")), "set-tiles")
    own = tiles.select(F.lit(True).alias("same"), F.col("rows").alias("a"), F.slice("rows", 1, 0).alias("b"))
    split = tiles.where("tiles > 1")
    # tile pairs are named first and then get their rows, so those of one key are dealt over tasks
    named = split.where("tile < tiles - 1").select("key", "tile", F.explode(F.expr("sequence(tile + 1, tiles - 1)")).alias("other"))
    left = split.select("key", "tile", F.col("rows").alias("a"))
    right = split.select("key", F.col("tile").alias("other"), F.col("rows").alias("b"))
    more = named.join(left, ["key", "tile"]).join(right, ["key", "other"]).select(F.lit(False).alias("same"), "a", "b")

    def run(batches):
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for same, *sides in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                nodes, shingles = zip(*[(x.values.field("node").to_numpy(zero_copy_only=False), list(x.values.field("shingles").to_numpy(zero_copy_only=False))) for x in sides])
                member, root = similar_sets(shingles[0], shingles[0] if same else shingles[1], same, similarity)
                node = np.concatenate(nodes)
                us.append(node[member])
                vs.append(node[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return own.union(more).mapInArrow(run, "u long, v long")


def _shingle_sets(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the ``texts`` (``node, doc_id, text_hash``), one text per node."""

    def run(batches):
        for batch in batches:
            found = [np.unique(_shingle_hashes((x.as_py() or "").encode(), width)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    both = keyed.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "text")
    return both.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def deduplicated(docs: DataFrame, width: int = 5, radius: int = 18, limit: int = 60, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: the first of each group stays.

    Texts whose sets of shingles have a Jaccard similarity of at least
    ``similarity`` are linked. Fingerprints find the candidates: within each
    component of close fingerprints all pairs of sets are compared exactly. For a similarity of 0.8 between sets of five-word shingles, sixteen bits of
    a hundred differ on average. So 256 bits are taken: the first 64 are compared
    exactly in tiles within ``radius``, candidates must agree within
    ``limit`` of all bits. First is the smallest ``doc_id`` (null last), then the
    smallest text hash; of equal rows one stays.
    """

    def run(batches):
        for batch in batches:
            sets = [np.unique(_shingle_hashes((x.as_py() or "").encode(), width)) for x in batch.column(2)]
            prints = np.stack([_wide(x) for x in sets]).view(np.int64) if sets else np.zeros((0, 4), np.int64)
            # texts with the same set of shingles are one node
            node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            more = pa.array(list(prints[:, 1:]), pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(prints[:, 0])), more, pa.array(node)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "more", "node"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    prints = keyed.mapInArrow(run, "doc_id long, text_hash long, fp long, more array<long>, node long")
    prints = written(prints, "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), first), "nodes")
    near = written(components(links(nodes.select("node", "fp", "more"), radius, limit)), "candidates")
    sets = _shingle_sets(docs, nodes.join(near, "node", "left_semi").select("node", "first.doc_id", "first.text_hash"), width)
    joined = components(exact_links(near.select(F.col("root").alias("key"), "node"), sets, similarity))
    rooted = nodes.select("node", "first").join(joined, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    copies = prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    keep = keep.join(copies, keep.doc_id.eqNullSafe(copies.doc_id) & (keep.text_hash == copies.text_hash)).select(
        keep.doc_id.alias("_id"), keep.text_hash.alias("_hash"), "copies"
    )
    keep = written(keep, "keep")
    rows = boxed(docs, k_id=F.col("doc_id").cast("long"), k_hash=F.xxhash64("text"))
    kept = rows.join(keep.select("_id", "_hash"), F.col("k_id").eqNullSafe(F.col("_id")) & (F.col("k_hash") == F.col("_hash")), "left_semi").select("row.*")
    if keep.where("copies > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
