"""Packing by first-fit decreasing with a tournament tree of bin capacities.

Documents fall into randomised groups by a seeded hash. A group is packed on its
own: each document's ids are cut into full sequences and a remainder, remainders
are placed longest first into the first bin with room, and a tournament tree
over the bins' free room finds that bin in logarithmic time. What then stands in
the emptiest bins is cut to fill the gaps of the fuller ones.

Defined results: null text counts as empty and holds the end id alone; a null
``doc_id`` is carried along; repeated rows are packed one by one; equal lengths
go in the order of ``doc_id`` and text hash; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.llm.tokens import encoder

LENGTH = 2048


def first_fit(sizes: list[int], capacity: int = LENGTH) -> list[int]:
    """Bin of each size, in the given order: the first bin with room."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = []
    for size in sizes:
        at = 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        bins.append(at - leaves)
        room[at] -= size
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return bins


def fill_gaps(pieces: list[tuple[int, int, int]], bins: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """``doc, start, length, bin, offset``: the pieces laid into their bins, those
    of the emptiest bins cut into the gaps of the others while they fit there."""
    content: dict[int, list] = {}
    for piece, b in zip(pieces, bins):
        content.setdefault(b, []).append(piece)
    used = {b: sum(p[2] for p in c) for b, c in content.items()}
    order = sorted(content, key=lambda b: (-used[b], b))
    gaps = [b for b in order if used[b] < capacity]
    low, high = 0, len(gaps) - 1
    free = sum(capacity - used[b] for b in gaps)
    while high > low and free - (capacity - used[gaps[high]]) >= used[gaps[high]]:
        source = gaps[high]
        free -= capacity - used[source]
        moving = content.pop(source)
        high -= 1
        while moving:
            doc, start, length = moving.pop()
            while used[gaps[low]] == capacity:
                low += 1
            target = gaps[low]
            part = min(length, capacity - used[target])
            content[target].append((doc, start, part))
            used[target] += part
            free -= part
            if part < length:
                moving.append((doc, start + part, length - part))
    out = []
    for number, b in enumerate(sorted(content)):
        offset = 0
        for doc, start, length in content[b]:
            out.append((doc, start, length, number, offset))
            offset += length
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """``doc, start, length, bin, offset`` of all pieces of documents 0, 1, ..."""
    rest = lengths % capacity
    short = np.flatnonzero(rest)
    short = short[np.argsort(-rest[short], kind="stable")]
    pieces = [(d, int(lengths[d] - rest[d]), int(rest[d])) for d in short.tolist()]
    out = fill_gaps(pieces, first_fit([p[2] for p in pieces], capacity), capacity)
    number = 1 + max((o[3] for o in out), default=-1)
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[d]) // capacity):
            out.append((d, k * capacity, capacity, number, 0))
            number += 1
    return out


def packed(docs: DataFrame, tokenizer: str, drops_space: bool = False, end_id: int = 1, length: int = LENGTH, group_rows: int = 2048, seed: int = 11) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; a
    sequence is its pieces in the order of ``offset``, padded to ``length``. The
    number of groups grows with the table, so a group keeps about ``group_rows``
    documents; ``sequence_id`` is the group times 2^31 plus the place in it.
    """
    groups = max(1, -(-docs.count() // group_rows))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(groups)))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        ids, bounds = encoder(tokenizer, drops_space).encode(group.column("text").combine_chunks())
        lengths = np.diff(bounds) + 1
        out = pack_lengths(lengths, length)
        doc, start, size, number, offset = (np.array(x, np.int64) for x in (zip(*out) if out else [[]] * 5))
        base = int(group.column("grp")[0].as_py()) << 31
        parts = []
        for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist()):
            part = ids[bounds[d] + s : min(bounds[d] + s + n, bounds[d + 1])].astype("<u4").tobytes()
            parts.append(part if len(part) == 4 * n else part + end_id.to_bytes(4, "little"))
        return pa.Table.from_arrays(
            [
                group.column("doc_id").take(pa.array(doc)),
                pa.array(start),
                pa.array(size),
                pa.array(parts, pa.binary()),
                pa.array(lengths[doc]),
                pa.array(number + base),
                pa.array(offset),
            ],
            names,
        )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return keyed.groupBy("grp").applyInArrow(run, schema)
