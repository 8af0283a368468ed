"""Token ids in files: canonical length-limited Huffman coding with checkpoints.

Format. A folder holds two Parquet tables. ``code`` has the code length of every
id that occurs (``id, bits``); codes are canonical, so lengths suffice. ``blocks``
has one row per block of whole documents in ascending ``doc_id`` order (null
first): ``part`` and ``block`` order the blocks, ``doc_ids`` and ``counts`` list the
documents, ``payload`` holds their codes, most significant bit first, each document
from a byte boundary on, and ``checkpoints`` the bit offset of every
``CHECKPOINT``-th id of each document. A block can be decoded without any other,
and all stretches between checkpoints advance together through one look-up table.

Defined results: null text counts as empty and holds the end id alone; a null
``doc_id`` sorts first; equal ids keep the order of their text hashes; repeated
rows are written one by one; an empty table gives an empty ``blocks`` table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aridscape.llm.common import written
from aridscape.llm.tokens import encoder

LIMIT = 20
CHECKPOINT = 128
BLOCK_IDS = 1 << 16
WORD_BITS = 32


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge (0: id does not occur)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        leaf_levels.append(np.cumsum(by_weight < len(weights)))
        merged = merged[by_weight]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * len(weights) - 2
    lengths = np.zeros(len(weights), np.int64)
    for leaves in reversed(leaf_levels):
        if not take:
            break
        chosen = int(leaves[take - 1])
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[order].astype(np.int64)
    if len(order):
        steps = np.left_shift(np.uint64(1), (WORD_BITS - bits).astype(np.uint64))
        left = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps)[:-1]])
        codes[order] = left >> (WORD_BITS - bits).astype(np.uint64)
    return codes


def pack_bits(codes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """Bytes with each code at its bit offset (ascending, not overlapping)."""
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(codes):
        slot = offsets >> 6
        room = 64 - (offsets & 63) - lengths
        fits = room >= 0
        value = np.where(fits, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        words[slot[first]] = np.bitwise_or.reduceat(value, first)
        over = np.flatnonzero(~fits)
        words[slot[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)


def encode_documents(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bytes, each document's first byte (and the end), and each id's bit offset within its document."""
    size = lengths[ids].astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(size)])
    bits = sums[bounds[1:]] - sums[bounds[:-1]]
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    inside = sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
    packed = pack_bits(codes[ids], size, inside + 8 * np.repeat(begin[:-1], np.diff(bounds)), int(8 * begin[-1]))
    return packed, begin, inside


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every next ``limit`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    repeat = np.left_shift(1, limit - lengths[order].astype(np.int64))
    symbols, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(repeat.sum())
    symbols[:n], bits[:n] = np.repeat(order, repeat), np.repeat(lengths[order], repeat)
    return symbols, bits


def decode_lanes(data: np.ndarray, begin: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids of stretches of ``counts`` ids (at most CHECKPOINT each) that begin at
    the given bits, one after the other; every step decodes one id of each."""
    symbols, bits = table
    data = np.concatenate([data, np.zeros(8 + CHECKPOINT * limit // 8, np.uint8)])
    at = begin.astype(np.int64).copy()
    out = np.empty((len(at), CHECKPOINT), np.uint32)
    last = len(data) - 5
    for k in range(int(counts.max(initial=0))):
        byte = np.minimum(at >> 3, last)
        word = (data[byte].astype(np.uint32) << np.uint32(24)) | (data[byte + 1].astype(np.uint32) << np.uint32(16))
        word |= (data[byte + 2].astype(np.uint32) << np.uint32(8)) | data[byte + 3]
        index = (word >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, k] = symbols[index]
        at += bits[index]
    return out[np.arange(CHECKPOINT)[None, :] < counts[:, None]]


def _staged(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int) -> DataFrame:
    """``doc_id, text_hash, ids`` with all ids of a document, the end id included."""

    def run(batches):
        code = encoder(tokenizer, drops_space)
        for batch in _small(batches, 2048):
            ids, bounds = code.encode(batch.column(2))
            parts = [ids[a:b].tobytes() + int(end_id).to_bytes(ids.itemsize, "little") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["doc_id", "text_hash", "ids"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return written(keyed.mapInArrow(run, "doc_id long, text_hash long, ids binary"), "ids")


def _small(batches, rows: int = 512):
    """The batches in pieces of few documents, which bounds what numpy holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _buffers(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and each row's bounds."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def id_counts(staged: DataFrame, dtype, size: int) -> np.ndarray:
    """Occurrences of every id over the whole table (the vocabulary bounds the result)."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in _small(batches):
            total += np.bincount(_buffers(batch.column(0), dtype)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, end_id: int, part_ids: int = 1 << 23) -> None:
    """Encode every document of ``docs`` into files under ``path``."""
    spark = docs.sparkSession
    model = encoder(tokenizer, drops_space)
    size, dtype = max(model.tokenizer.get_vocab_size(), end_id + 1), np.dtype(model.dtype).str
    staged = _staged(docs, tokenizer, drops_space, end_id)
    counts = id_counts(staged, dtype, size)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    table = pa.table({"id": pa.array(used.astype(np.int32)), "bits": pa.array(lengths[used].astype(np.int32))})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/code")

    def encode(batches):
        codes = canonical_codes(lengths)
        for batch in _small(batches):
            ids, bounds = _buffers(batch.column("ids"), dtype)
            packed, begin, inside = encode_documents(ids, bounds, codes, lengths)
            parts = [packed[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            marks = [inside[a:b:CHECKPOINT] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(parts, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
                ["part", "doc_id", "n", "bits", "marks"],
            )

    # ids are ordered before they are coded: the sample for the ranges then only reads the staged files
    parts = max(1, -(-int(counts.sum()) // part_ids))
    ordered = staged.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    coded = numbered.mapInArrow(encode, "part int, doc_id long, n long, bits binary, marks array<long>")

    def blocks(batches):
        held, ids_held, number, part = [], 0, 0, 0

        def block():
            sizes = np.cumsum([0] + [len(r[2]) for r in held])
            marks = np.concatenate([np.asarray(r[3]) + 8 * at for r, at in zip(held, sizes.tolist())])
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "n_ids": pa.array([ids_held], pa.int64()),
                    "doc_ids": pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                    "counts": pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
                    "checkpoints": pa.array([marks], pa.list_(pa.int64())),
                    "payload": pa.array([b"".join(r[2] for r in held)], pa.binary()),
                }
            )

        for batch in _small(batches):
            columns = [batch.column(k).to_pylist() if k != "marks" else [x.values.to_numpy() for x in batch.column(k)] for k in ("doc_id", "n", "bits", "marks")]
            part = batch.column("part")[0].as_py()
            for row in zip(*columns):
                held.append(row)
                ids_held += row[1]
                if ids_held >= BLOCK_IDS:
                    yield block()
                    held, ids_held, number = [], 0, number + 1
        if held:
            yield block()

    schema = "part int, block int, n_ids long, doc_ids array<long>, counts array<long>, checkpoints array<long>, payload binary"
    coded.mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files under
    ``path``; ``ids`` as little-endian unsigned 32-bit integers."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(1 + max((r["id"] for r in code), default=0), np.uint8)
    for r in code:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("block")
    starts = blocks.select("part", "block", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inner")).join(sums, "part")
    starts = starts.select("part", "block", (F.col("before") + F.col("inner")).alias("first"))

    def decode(batches):
        table = decode_table(lengths)
        for batch in batches:
            for at in range(batch.num_rows):
                counts = batch.column("counts")[at].values.to_numpy()
                marks = batch.column("checkpoints")[at].values.to_numpy()
                lanes = -(-counts // CHECKPOINT)
                size = np.full(len(marks), CHECKPOINT)
                size[np.cumsum(lanes) - 1] = counts - CHECKPOINT * (lanes - 1)
                payload = np.frombuffer(batch.column("payload")[at].as_buffer(), np.uint8)
                ids = decode_lanes(payload, marks, size, table).astype("<u4")
                upto = np.cumsum(counts)
                begin = upto - counts
                parts = [ids[a:b].tobytes() for a, b in zip(begin.tolist(), upto.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[at].values,
                        pa.array(begin + batch.column("first")[at].as_py()),
                        pa.array(counts),
                        pa.array(parts, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.select("part", "block", "doc_ids", "counts", "checkpoints", "payload").join(starts, ["part", "block"])
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def checksums(read_back: DataFrame) -> DataFrame:
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
