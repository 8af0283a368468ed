"""Prefix trie of conversations from sorted sequences, without building a tree.

Distinct turn sequences are sorted; ``lcp[i]`` is the number of leading turns
that sequence ``i`` shares with the one before it. The members of a prefix are
one interval of the order. Its ends are found by two binary searches over a
sparse table of range minima, each prefix and each side for itself.

Steps on Spark:

1. A turn becomes 128 bits of SHA-256 over role and text, so only 20 bytes a
   turn are shuffled. A conversation is the unit: one row of 20 bytes a turn.
2. Equal sequences become one row with their number, smallest id and the digest
   of their ids. Ids go there in chunks of 256 neighbouring numbers, so a
   sequence that very many conversations share arrives as few, bounded rows and
   is digested as a stream (SHA-256 itself cannot be computed in parts).
3. The rows are range-partitioned by sequence and worked off in blocks, which
   know the sequence before and behind them. All figures of a node are sums or
   minima over its interval, and every distinct node counts in the block where
   it first occurs, so a node that spans blocks is the sum of its parts. Such
   parts (two paths a block at most) are added up by the prefix's digest; all
   other nodes are final inside their block.

Defined cases: null role or text counts as empty; equal ``turn`` values are
ordered by role, then digest; rows without ``conv_id`` take no part; repeated
rows are turns of their own; further columns are ignored; an empty table has no
node, a table with only turnless conversations has the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aridscape.llm.common import written

#: Bytes of a turn's digest in a key.
WIDTH = 16
#: Conversation ids that one row of the second step can hold.
CHUNK_BITS = 8
#: Sequences and turns of a block.
BLOCK_SEQUENCES = 32_768
BLOCK_TURNS = 1 << 20
NO_END = hashlib.sha256(b"").hexdigest()

_SEQUENCE = "key binary, lens binary, n long, least long, ends string"
_NODE = (
    "block long, pid binary, parent_pid binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
COLUMNS = ("conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256")


def paths(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, path``: each conversation's turns in order, as (digest, bytes of the text)."""
    said_by, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said)
    turn = F.struct(
        F.col(f"`{order}`").isNotNull().alias("has"),
        F.col(f"`{order}`").alias("at"),
        said_by.alias("role"),
        F.substring(F.sha2(plain, 256), 1, 2 * WIDTH).alias("h"),
        F.octet_length(said).alias("bytes"),
    )
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["bytes"].alias("bytes"))).alias("path"))


def with_heads(convs: DataFrame, source: Column, turns: Column, most: int) -> DataFrame:
    """Paths whose first ``turns`` turns (at most ``most``) are those of the
    conversation ``source``: all it has if fewer, none if there is no such one."""
    heads = convs.select(F.col("conv_id").alias("source"), F.slice("path", 1, most).alias("head"))
    asked = convs.select("conv_id", "path", source.alias("source"), turns.alias("h"))
    head = F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return asked.join(heads, "source", "left").select("conv_id", F.concat(head, own).alias("path"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from chunks sorted by key and chunk; ids are hashed as they pass."""
    schema = pa.schema([("key", pa.binary()), ("lens", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    open_key, row, digest, out = None, None, None, []
    for batch in batches:
        for key, lens, n, least, ids in zip(*[batch.column(c).to_pylist() for c in ("key", "lens", "n", "least", "ids")]):
            if key != open_key:
                if row:
                    out.append((*row, digest.hexdigest()))
                open_key, row, digest = key, (key, lens, n, least), hashlib.sha256(ids.encode())
            else:
                row = (key, lens, row[2] + n, min(row[3], least))
                digest.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if row:
        out.append((*row, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences of ``paths``: key, text lengths, number and smallest id
    of their conversations, SHA-256 of all their ids in ascending order."""

    def packed(item) -> Column:
        return F.unhex(F.array_join(F.transform("path", item), ""))

    keyed = convs.select("conv_id", packed(lambda t: t["h"]).alias("key"), packed(lambda t: F.lpad(F.hex(t["bytes"]), 8, "0")).alias("lens"))
    chunks = keyed.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.first("lens").alias("lens"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_distinct, _SEQUENCE)


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two keys share."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k, np.uint8, n * WIDTH).reshape(n, WIDTH) for k in (a, b))
    unlike = np.flatnonzero((x != y).any(axis=1))
    return int(unlike[0]) if len(unlike) else n


def neighbour_lcp(turns: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shared leading turns of each sequence (rows of ``turns`` from ``first``) and the one before it."""
    both = np.minimum(length[1:], length[:-1])
    pair = np.repeat(np.arange(len(both)), both)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
    unlike = np.flatnonzero((turns[first[1:][pair] + at] != turns[first[:-1][pair] + at]).any(axis=1))[::-1]
    lcp = both.copy()
    lcp[pair[unlike]] = at[unlike]  # the first difference is assigned last
    return lcp


class RangeMin:
    """Sparse table: minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values ``lo .. hi``, both included."""
        power = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k, level in enumerate(self.levels):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(level[lo[at]], level[hi[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r for which values ``at + 1 .. r`` are all ``least`` or more."""
        r = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = r + (1 << k)
            level = self.levels[k]
            r = np.where((to < self.size) & (level[np.minimum(r + 1, len(level) - 1)] >= least), to, r)
        return r

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l for which values ``l + 1 .. at`` are all ``least`` or more."""
        left = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = left - (1 << k)
            level = self.levels[k]
            left = np.where((to >= 0) & (level[np.clip(to + 1, 0, len(level) - 1)] >= least), to, left)
        return left


def _prefix_digests(key: bytes, depths: set[int]) -> dict[int, bytes]:
    """Digest of the first d turns of a key, for the wanted d."""
    out, digest, done = {}, hashlib.sha256(), 0
    for d in sorted(depths):
        digest.update(key[done : d * WIDTH])
        done = d * WIDTH
        out[d] = digest.copy().digest()[:WIDTH]
    return out


def block_nodes(block: int, rows: list[tuple], before: bytes | None, behind: bytes | None) -> pa.RecordBatch:
    """Nodes of consecutive sequences (key, lens, n, least, ends); ``before`` and
    ``behind`` are the neighbouring keys. A node that reaches into a neighbour
    has ``pid``: its figures are this block's share. ``parent_pid`` stands
    wherever the parent reaches into a neighbour."""
    keys, lens, n, least, ends = zip(*rows)
    size = len(keys)
    length = np.fromiter((len(k) // WIDTH for k in keys), np.int64, size)
    first = np.cumsum(length) - length
    turns = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    inner = np.full(size + 1, -1, np.int64)  # as if the block stood alone
    inner[1:size] = neighbour_lcp(turns, first, length)
    lcp = inner.copy()
    lcp[0] = -1 if before is None else shared_turns(before, keys[0])
    lcp[size] = -1 if behind is None else shared_turns(keys[-1], behind)

    # prefixes where the trie branches or a sequence ends; each finds its own interval
    at = np.concatenate([np.arange(size), np.arange(1, size)])
    depth = np.concatenate([length, inner[1:size]])
    minima = RangeMin(inner[:size])
    left, right = minima.left(at, depth), minima.right(at, depth)
    _, one, which = np.unique(left * (size + 1) + right, return_index=True, return_inverse=True)
    left, right, deep = left[one], right[one], depth[one]
    branches = np.bincount(which[size:], minlength=len(one))
    low = np.maximum(inner[left], inner[right + 1])
    upper = np.where(inner[left] >= inner[right + 1], left, right + 1)
    upper = np.where(low >= 0, which[np.clip(size + upper - 1, 0, len(which) - 1)], -1)
    smallest = RangeMin(np.array(least, np.int64)).between(left, right)

    # all depths between an interval's parent and itself
    node = np.repeat(np.arange(len(one)), deep - low)
    d = np.arange(len(node)) - np.repeat(np.cumsum(deep - low) - (deep - low), deep - low) + low[node] + 1
    l, r = left[node], right[node]

    def sums(values) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.asarray(values, np.int64))])

    n = np.array(n, np.int64)
    text = sums(np.frombuffer(b"".join(lens), ">u4"))

    def bytes_upto(sequence: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return text[first[sequence] + turns] - text[first[sequence]]

    every = np.arange(size)
    whole_text = bytes_upto(every, length)
    members, said, leaves = sums(n), sums(n * whole_text), sums(lcp[1:] < length)
    new_text = sums(whole_text - bytes_upto(every, np.maximum(lcp[:size], 0)))
    n_convs = members[r + 1] - members[l]
    above = np.maximum(d - 1, 0)
    spoken = said[r + 1] - said[l] - n_convs * bytes_upto(l, above)
    once = new_text[r + 1] - new_text[l + 1] + whole_text[l] - bytes_upto(l, np.maximum(above, lcp[l]))
    continues = (lcp[l] <= d) & (d < length[l])
    n_children = np.where(d == deep[node], branches[node], 0) + continues

    def reaches_out(lo, hi, depth) -> np.ndarray:
        return ((lo == 0) & (lcp[0] >= depth)) | ((hi == size - 1) & (lcp[size] >= depth))

    parent = np.where(d > low[node] + 1, node, upper[node])
    has_parent = d > 0
    open_node = reaches_out(l, r, d)
    open_parent = has_parent & reaches_out(left[parent], right[parent], d - 1)
    pid = np.full(len(node), None, object)
    parent_pid = np.full(len(node), None, object)
    for mine, key in ((True, keys[0]), (False, keys[-1])):
        own = np.flatnonzero(open_node & ((l == 0) == mine))
        up = np.flatnonzero(open_parent & ((left[parent] == 0) == mine))
        digests = _prefix_digests(key, set(d[own].tolist()) | set((d[up] - 1).tolist()))
        for i in own.tolist():
            pid[i] = digests[int(d[i])]
        for i in up.tolist():
            parent_pid[i] = digests[int(d[i]) - 1]
    known_parent = has_parent & ~open_parent
    ends = np.array(ends, object)
    columns = [
        pa.array(np.full(len(node), block, np.int64)),
        pa.array(pid, pa.binary()),
        pa.array(parent_pid, pa.binary()),
        pa.array(smallest[node]),
        pa.array(d),
        pa.array(np.where(known_parent, smallest[parent], 0), mask=~known_parent),
        pa.array(n_convs),
        pa.array(n_children),
        pa.array(leaves[r + 1] - leaves[l]),
        pa.array(spoken - once),
        pa.array(np.where(length[l] == d, ends[l], NO_END), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _NODE.split(", ")])


def _blocks(sequences_of_block: int, turns_of_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, rows, turns, number = None, None, [], 0, 0

        def close(behind: bytes | None):
            nonlocal before, rows, turns, number
            done = block_nodes((part << 32) + number, rows, before, behind)
            before, rows, turns, number = rows[-1][0], [], 0, number + 1
            return done

        for batch in batches:
            names = ("part", "key", "lens", "n", "least", "ends")
            for here, *row in zip(*[batch.column(c).to_pylist() for c in names]):
                if here != part:
                    if rows:
                        yield close(None)
                    part, before, number = here, None, 0
                if not row[2]:  # the key next to this part
                    if rows:
                        yield close(row[0])
                    before = row[0]
                    continue
                if rows and (len(rows) >= sequences_of_block or turns >= turns_of_block):
                    yield close(row[0])
                rows.append(tuple(row))
                turns += len(row[0]) // WIDTH
        if rows:
            yield close(None)

    return run


def nodes(convs: DataFrame, block_sequences: int = BLOCK_SEQUENCES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of ``convs`` (conv_id, path): see ``COLUMNS``."""
    distinct = written(sequences(convs), "trie-sequences")
    # part numbers must stay the same for the neighbours' keys and the rows
    placed = written(distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "trie-parts")
    edges = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("part")  # one row per part
    edges = edges.select("part", F.lag("last").over(order).alias("last"), F.lead("first").over(order).alias("first"))
    beside = edges.select("part", F.explode(F.array("last", "first")).alias("key")).where("key IS NOT NULL")
    rows = placed.unionByName(beside.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    rows = rows.repartition("part").sortWithinPartitions("part", "key")
    found = written(rows.mapInArrow(_blocks(block_sequences, block_turns), _NODE), "trie-nodes")

    shares = found.where("pid IS NOT NULL")
    merged = shares.groupBy("pid").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_pid").alias("parent_pid"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.max(F.when(F.col("ends_sha256") != NO_END, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    merged = written(merged.fillna(NO_END, ["ends_sha256"]), "trie-merged")
    parents = merged.select(F.col("pid").alias("parent_pid"), F.col("conv_id").alias("parent_conv_id"))
    spanning = merged.join(parents, "parent_pid", "left").select(*COLUMNS)
    whole = found.where("pid IS NULL")
    final = whole.where("parent_pid IS NULL").select(*COLUMNS)
    # a block asks once for each of its spanning prefixes, whatever their number of children
    asked = shares.select("block", F.col("pid").alias("parent_pid")).join(parents, "parent_pid")
    below = whole.where("parent_pid IS NOT NULL").drop("parent_conv_id").join(asked, ["block", "parent_pid"]).select(*COLUMNS)
    return final.unionByName(below).unionByName(spanning)
