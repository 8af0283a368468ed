"""Katz backoff language model: Good-Turing counts in partitioned tables.

p(w | h) is d(c) c(hw) / c(h) for n-grams seen in training and a(h) p(w | h')
otherwise, where h' is h without its first word, d the Good-Turing discounts for
counts up to ``TOP`` and a(h) the weight that makes the probabilities of all known
words and of the unknown word add up to one. The recursion ends at single words;
words that training does not hold share the mass that discounting frees.

Documents are turned into chunks of some million tokens with a vocabulary of their
own. Words and n-grams are numbered in the partition that counts them, so a context
is known by the number of the n-gram it is. Per level, every chunk sends each distinct
n-gram once, with its count and that of the next lower level, to the partition that
numbered its context; the partition adds counts over all chunks and answers with counts,
numbers and, per context that several chunks ask for, the counts of counts from which
its backoff weight follows (an n-gram seen in training has a lower one that is seen too,
so its probability is a discounted count over the lower context's divisor). A context
that is very frequent is spread over several partitions by its next word, and the chunks
add up the sums. Only counts of counts reach the driver. Where a path is given, the tables
stay there. ``level=1/kind=model``: hashes, codes (number * partitions + partition) and
counts of words; ``level=n/kind=model``: contexts (identities of the level below, by
their differences), their numbers of n-grams, then codes of last words, counts and own
numbers (by their differences) of the n-grams, by partition.

Defined results: null text is empty and holds the end of text alone; a document
without id counts as held out (its id's text is empty); repeated rows are
documents of their own; without training tokens every token is the unknown word
of probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aridscape.llm.common import remove, scratch_path
from aridscape.llm.words import mixed, slices

TOP = 5
CHUNK = 2_000_000
HOT = 2_000_000
ENTRIES = 1_000_000
END = np.uint64(1)
#: A word's or n-gram's identity: partition * 2^NUMBER + its number there (from 1).
NUMBER = 40
NUMBERS = (1 << NUMBER) - 1
CHUNKS = (
    "kind string, chunk long, vocabulary binary, counts binary, doc_ids array<long>, train binary, lengths binary, ranks binary, tokens binary, n_train long, n_tokens long"
)
RESULT = "kind string, bucket long, chunk long, numbers array<long>, parts array<binary>"


def packed(values: np.ndarray) -> bytes:
    """An array as zstd-compressed byte planes, integers in the fewest bytes."""
    if values.dtype.kind in "iu":
        top = int(values.max()) if len(values) else 0
        values = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return values.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8).reshape(kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return values.astype(np.int64) if kind.kind == "u" and kind.itemsize < 8 else values


def _row(kind: str, bucket: int, chunk: int, numbers: list[int], parts: list[bytes]) -> tuple:
    return kind, bucket, chunk, numbers, parts


def _table(rows: list[tuple], schema=("kind", "bucket", "chunk", "numbers", "parts")) -> pa.Table:
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(schema))


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Two rows per chunk: ``words`` (vocabulary and its counts) and ``body`` (the documents)."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def chunk():
            hashes, length = np.concatenate(tokens), np.concatenate(lengths)
            train = np.fromiter(map(in_training, ids), bool, len(ids))
            vocabulary, place = np.unique(hashes, return_inverse=True)
            counts = np.bincount(place[np.repeat(train, length)], minlength=len(vocabulary))
            by_use = np.argsort(-np.bincount(place), kind="stable")
            ranks = np.empty(len(vocabulary), np.int64)
            ranks[by_use] = np.arange(len(vocabulary))
            values = {
                "kind": (pa.string(), "words", "body"),
                "chunk": (pa.int64(), (task << 32) + number, (task << 32) + number),
                "vocabulary": (pa.binary(), vocabulary.tobytes(), None),
                "counts": (pa.binary(), packed(counts), None),
                "doc_ids": (pa.list_(pa.int64()), None, ids),
                "train": (pa.binary(), None, packed(train.astype(np.uint8))),
                "lengths": (pa.binary(), None, packed(length)),
                "ranks": (pa.binary(), None, packed(ranks)),
                "tokens": (pa.binary(), None, packed(ranks[place])),
                "n_train": (pa.int64(), None, int(train.sum())),
                "n_tokens": (pa.int64(), None, len(hashes)),
            }
            return pa.RecordBatch.from_arrays([pa.array(list(v[1:]), v[0]) for v in values.values()], list(values))

        for batch in batches:
            names = batch.column(0).to_pylist()
            for s in slices(batch.column(1)):
                words = s.hashes(lower=True)
                words[words == END] = np.uint64(2)
                tokens.append(np.insert(words, s.bounds[1:], END))
                lengths.append(np.diff(s.bounds) + 1)
                ids.extend(names[s.first : s.first + s.rows])
                held += len(tokens[-1])
                if held >= size:
                    yield chunk()
                    ids, lengths, tokens, held, number = [], [], [], 0, number + 1
        if ids:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``bucket, from, to`` of ascending 64-bit keys by their first ``bits`` bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def _word_requests(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                vocabulary = np.frombuffer(batch.column("vocabulary")[at].as_py(), np.uint64)
                counts = unpacked(batch.column("counts")[at].as_py())
                chunk = batch.column("chunk")[at].as_py()
                rows = [_row("ask", b, chunk, [], [vocabulary[i:j].tobytes(), packed(counts[i:j])]) for b, i, j in _cuts(vocabulary, bits)]
                yield from _table(rows).to_batches()

    return chunks.select("chunk", "vocabulary", "counts").mapInArrow(run, RESULT)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[counts <= TOP + 1], minlength=TOP + 2)[1 : TOP + 2].tolist()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, a place of each, and every place's rank among them."""
    order = np.argsort(keys)
    ascending = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ascending[1:] != ascending[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return ascending[fresh], order[fresh], rank


def _steps(numbers: np.ndarray) -> bytes:
    """Numbers by their differences, which are small where they ascend."""
    return packed(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def _stepped(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).astype(np.uint64), dtype=np.uint64).astype(np.int64)


def _sums(owner: np.ndarray, counts: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Per context, of its n-grams seen in training: how many have the count 1 .. TOP and
    the sum of the others' counts; the same for the counts of the next lower level."""
    rows = []
    for x in (counts, low):
        few = np.bincount(np.minimum(x, TOP + 1) * n + owner, minlength=(TOP + 2) * n).reshape(TOP + 2, n)
        many = x > TOP
        rows += [few[1 : TOP + 1], np.bincount(owner[many], x[many], n).astype(np.int64)[None]]
    return np.concatenate(rows)


def _merge_words(bits: int, keep: bool):
    """Per partition of word hashes: global counts and numbers, frequent words first."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        chunks, parts = group.column("chunk").to_pylist(), group.column("parts").to_pylist()
        hashes = [np.frombuffer(p[0], np.uint64) for p in parts]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, place, np.concatenate([unpacked(p[1]) for p in parts]))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(1, len(words) + 1)
        rows, at = [], 0
        for chunk, h in zip(chunks, hashes):
            mine = place[at : at + len(h)]
            rows.append(_row("answer", bucket, chunk, [], [packed(number[mine]), packed(counts[mine])]))
            at += len(h)
        rows.append(_row("stats", bucket, -1, [int(counts.sum()), int((counts > 0).sum()), *_counts_of_counts(counts)], []))
        if keep:
            rows.append(_row("model", bucket, -1, [], [words.tobytes(), packed((number << bits) + bucket), packed(counts)]))
        return _table(rows)

    return run


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts d(1) .. d(TOP) from the numbers of n-grams seen 1 .. TOP + 1 times.

    Where the Good-Turing estimate is not between 0 and 1, as when a count is
    missing, the absolute discount n1 / (n1 + 2 n2) takes its place.
    """
    share = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    plain = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    plain = min(max(plain, 0.05), 0.95)
    out = np.empty(TOP)
    for r in range(1, TOP + 1):
        value = ((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share) if n[r - 1] and share < 1 else 0.0
        out[r - 1] = value if 0 < value < 1 else (r - plain) / r
    return out


def _discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], discounts * np.arange(1, TOP + 1)])
    return np.where(counts <= TOP, table[np.minimum(counts, TOP)], counts.astype(np.float64))


def word_model(total: int, n: list[int], discounts: np.ndarray) -> tuple[float, float]:
    """Divisor of discounted counts and probability of the unknown word."""
    if not total:
        return 1.0, 1.0
    held = total - sum(n[r - 1] * r * (1 - discounts[r - 1]) for r in range(1, TOP + 1))
    divisor = float(total) if total - held > 1e-9 * total else total + 1.0
    return divisor, 1 - held / divisor


class Chunk:
    """A chunk's tokens, and the probabilities of each level that is answered."""

    def __init__(self, row: dict, answers: dict[int, list], levels: dict[int, tuple], documents: int, bits: int):
        self.lengths = unpacked(row["lengths"])
        train = unpacked(row["train"]).astype(bool)
        self.documents = documents
        first = np.zeros(int(self.lengths.sum()), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        self.first = first
        self.train = np.repeat(train, self.lengths)
        order = np.argsort(unpacked(row["ranks"]))
        tokens = order[unpacked(row["tokens"])]
        mine = sorted(answers[1])
        number = [unpacked(p[0]) for _, p in mine]
        bucket = np.repeat(np.array([b for b, _ in mine], np.int64), list(map(len, number)))
        number, counts = np.concatenate(number), np.concatenate([unpacked(p[1]) for _, p in mine])
        self.bits = bits
        self.code, _, by_code = _distinct((number << bits) + bucket)
        self.word = by_code[tokens]
        self.ident, at, by_ident = _distinct((bucket << NUMBER) + number)
        self.gram, self.count = by_ident[tokens], counts[at]
        total, distinct, discounts, divisor, unknown = levels[1]
        self.total, self.distinct = total, distinct
        self.words = self.count[self.gram]
        self.probability = np.where(self.words > 0, _discounted(self.words, discounts) / divisor, unknown)
        self.divisor = np.full(len(tokens), divisor)
        self.discounts = discounts
        self.level = 1

    def requests(self, hot: int) -> None:
        """Distinct n-grams of the next level, in the order in which they are asked for."""
        self.level += 1
        # a context is the n-gram that ends before the word; 0 stands before the text
        context = np.concatenate([[0], self.gram[:-1] + 1])
        context[self.first] = 0
        self.ident_before = np.concatenate([[0], self.ident])
        frequency = np.concatenate([[self.documents], self.count])
        grams, self.at, self.place = _distinct(context * len(self.code) + self.word)
        self.of, word = np.divmod(grams, len(self.code))
        self.counts = np.bincount(self.place[self.train], minlength=len(grams))
        self.low = self.count[self.gram[self.at]]
        # the n-grams of a spread context lie in several partitions, by their last word
        home, last = self.ident_before >> NUMBER, (1 << self.bits) - 1
        parts = np.minimum(1 + frequency // hot, 1 << self.bits)
        bucket, n = home[self.of], len(home)
        wide = np.flatnonzero(parts[self.of] > 1)
        if len(wide):
            salt = (mixed(self.code[word[wide]]) % parts[self.of[wide]].astype(np.uint64)).astype(np.int64)
            bucket[wide] = (bucket[wide] + salt) & last
            order = np.argsort(bucket, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.place = back[self.place]
            self.at, self.of, self.counts, self.low, word, bucket = (x[order] for x in (self.at, self.of, self.counts, self.low, word, bucket))
        self.words_asked = self.code[word]
        runs, lengths = np.unique(bucket * n + self.of, return_counts=True)
        if len(wide):
            # every part of a spread context is asked for its sums
            spread = [((home[c] + np.arange(parts[c])) & last) * n + c for c in np.unique(self.of[parts[self.of] > 1])]
            every = np.union1d(runs, np.concatenate(spread))
            self.run_length = np.zeros(len(every), np.int64)
            self.run_length[np.searchsorted(every, runs)] = lengths
        else:
            every, self.run_length = runs, lengths
        self.run_bucket, self.run_context = np.divmod(every, n)

    def asked(self, chunk: int) -> list[tuple]:
        ends = np.concatenate([[0], np.cumsum(self.run_length)])
        ident = self.ident_before[self.run_context]
        first = np.flatnonzero(np.diff(self.run_bucket, prepend=-1))
        rows = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(ident)]):
            bucket, a, b = int(self.run_bucket[i]), int(ends[i]), int(ends[j])
            parts = [packed((ident[i:j] >> NUMBER) ^ bucket), _steps(ident[i:j] & NUMBERS)]
            parts += [packed(x) for x in (self.run_length[i:j], self.words_asked[a:b], self.counts[a:b], self.low[a:b])]
            rows.append(_row("ask", bucket, chunk, [self.level], parts))
        return rows

    def answered(self, answers: list, discounts: np.ndarray) -> None:
        """Counts and probabilities of this level from its answers."""
        answers = sorted(answers)
        mine = [p for _, p in answers]
        counts = np.concatenate([unpacked(p[0]) for p in mine])
        # what no other chunk asked for follows from the chunk's own n-grams
        shared = np.concatenate([unpacked(p[1]) for p in mine]).astype(bool)
        held = self.counts > 0
        owner = np.repeat(np.arange(len(shared)), self.run_length)[held]
        sums = _sums(owner, self.counts[held], self.low[held], len(shared))
        sums[:, shared] = np.concatenate([unpacked(p[2]).reshape(2 * (TOP + 1), -1) for p in mine], axis=1)
        n = len(self.ident_before)
        sums = np.stack([np.bincount(self.run_context, x, n) for x in sums])
        at = np.arange(1, TOP + 1)
        total, kept = at @ sums[:TOP] + sums[TOP], (discounts * at) @ sums[:TOP] + sums[TOP]
        divisor_below = np.ones(n)
        divisor_below[self.of] = self.divisor[self.at]
        low = ((self.discounts * at) @ sums[TOP + 1 : -1] + sums[-1]) / divisor_below
        divisor = np.where(total - kept > 1e-9 * total, total, total + 1)
        weight = np.where(total > 0, (1 - kept / divisor) / np.maximum(1 - low, 1e-300), 1.0)
        below = self.probability[self.at]
        probability = np.where(counts > 0, _discounted(counts, discounts) / divisor[self.of], weight[self.of] * below)
        self.probability, self.divisor = probability[self.place], divisor[self.of][self.place]
        self.gram, self.count, self.discounts = self.place, counts, discounts
        if len(mine[0]) > 3:
            # n-grams in ascending order of their identity, as they were asked for
            self.ident = np.concatenate([(b << NUMBER) + _stepped(p[3]) for b, p in answers])

    def scores(self, doc_ids: list) -> pa.Table:
        ends = np.cumsum(self.lengths)
        begin = ends - self.lengths

        def add(x):
            return np.add.reduceat(x, begin) if len(begin) else x[:0]

        base = np.log10((self.words + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        n = len(begin)
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "held_out": pa.array(~self.train[begin]),
                "n_tokens": pa.array(self.lengths.astype(np.int64)),
                "n_known": pa.array(add((self.words > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(n, self.total, np.int64)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(self.probability))),
            }
        )


def _chunk_of(table: pa.Table, answers: pa.Table, levels: dict, documents: int, hot: int, bits: int) -> tuple[Chunk, dict]:
    row = {k: table.column(k)[0].as_py() for k in ("chunk", "doc_ids", "train", "lengths", "ranks", "tokens")}
    by_level: dict[int, list] = {}
    for level, bucket, parts in zip(*(answers.column(k).to_pylist() for k in ("level", "bucket", "parts"))):
        by_level.setdefault(level, []).append((bucket, parts))
    view = Chunk(row, by_level, levels, documents, bits)
    for level in range(2, len(levels) + 1):
        view.requests(hot)
        view.answered(by_level[level], levels[level][2])
    return view, row


def _merge_grams(last: bool, keep: bool):
    """Per partition of contexts: counts over all chunks, answers and, to keep, tables."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        by_chunk = sorted(zip(group.column("chunk").to_pylist(), group.column("parts").to_pylist()), key=lambda x: x[0])
        contexts, lengths, words, counts, lows = [], [], [], [], []
        for _, (home, number, length, word, count, low) in by_chunk:
            contexts.append(((unpacked(home) ^ bucket) << NUMBER) + _stepped(number))
            for column, x in ((lengths, length), (words, word), (counts, count), (lows, low)):
                column.append(unpacked(x).astype(np.int64))
        runs, of_run, askers = np.unique(np.concatenate(contexts), return_inverse=True, return_counts=True)
        of, word = np.repeat(of_run, np.concatenate(lengths)), np.concatenate(words)
        width = int(word.max(initial=0)).bit_length()
        key, at, entry = _distinct((of << width) + word)
        total = np.bincount(entry, np.concatenate(counts), len(key)).astype(np.int64)
        seen = np.flatnonzero(total)
        owner, got = key[seen] >> width, total[seen]
        sums = _sums(owner, got, np.concatenate(lows)[at[seen]], len(runs))
        rows, g, r = [], 0, 0
        for (chunk, _), c, w in zip(by_chunk, contexts, words):
            mine, asked = of_run[r : r + len(c)], entry[g : g + len(w)]
            shared = askers[mine] > 1
            parts = [packed(total[asked]), packed(shared.astype(np.uint8)), packed(sums[:, mine[shared]].ravel())]
            rows.append(_row("answer", bucket, chunk, [], parts if last else [*parts, _steps(asked + 1)]))
            g, r = g + len(w), r + len(c)
        rows.append(_row("stats", bucket, -1, [int(got.sum()), len(got), *_counts_of_counts(got)], []))
        if keep:
            own, lengths = np.unique(owner, return_counts=True)
            parts = [_steps(runs[own]), packed(lengths), packed(key[seen] & ((1 << width) - 1)), packed(got), _steps(seen + 1)]
            rows.append(_row("model", bucket, -1, [], parts))
        return _table(rows)

    return run


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: once Python has let go
    of its handles, the driver's next collection finds them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score(docs: DataFrame, order: int = 3, path: str | None = None, chunk: int = CHUNK, hot: int = HOT, entries: int = ENTRIES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    The model learns from the documents for which ``in_training`` holds; its
    tables are kept under ``path``, if one is given.
    """
    spark = docs.sparkSession
    keep = path is not None
    path = path or f"{scratch_path(spark, 'katz')}/model"

    def write(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/{name}")
        _release(spark)
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    chunks = write(_chunks(docs, chunk), "chunks", CHUNKS)
    body = chunks.where("kind = 'body'").select("chunk", "doc_ids", "train", "lengths", "ranks", "tokens")
    documents, tokens = chunks.where("kind = 'body'").agg(F.sum("n_train"), F.sum("n_tokens")).first()
    if tokens is None:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    bits = max(0, math.ceil(math.log2(tokens / entries)))
    hot = max(hot, tokens >> 12)
    levels: dict[int, tuple] = {}

    def learnt(level: int, merged: DataFrame) -> DataFrame:
        table = write(merged, f"level={level}", RESULT)
        rows = table.where("kind = 'stats'").agg(*[F.sum(F.col("numbers")[i]) for i in range(TOP + 3)]).first()
        total, distinct, *n = [x or 0 for x in rows]
        discounts = good_turing(n)
        levels[level] = (total, distinct, discounts, *(word_model(total, n, discounts) if level == 1 else ()))
        return table.where("kind = 'answer'").select("chunk", "bucket", F.lit(level).alias("level"), "parts")

    answers = learnt(1, _word_requests(chunks.where("kind = 'words'"), bits).groupBy("bucket").applyInArrow(_merge_words(bits, keep), RESULT))
    # the words now have numbers
    remove(spark, f"{path}/chunks/kind=words")
    def asking(known: dict[int, tuple]):
        def ask(table: pa.Table, given: pa.Table) -> pa.Table:
            view, row = _chunk_of(table, given, known, documents, hot, bits)
            view.requests(hot)
            return _table(view.asked(row["chunk"]))

        return ask

    for level in range(2, order + 1):
        asked = body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(asking(dict(levels)), RESULT)
        answers = answers.union(learnt(level, asked.groupBy("bucket").applyInArrow(_merge_grams(level == order, keep), RESULT)))

    def rate(table: pa.Table, given: pa.Table) -> pa.Table:
        view, row = _chunk_of(table, given, levels, documents, hot, bits)
        return view.scores(row["doc_ids"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate, schema)
