"""Repeated passages by paragraph MinHash banding.

A paragraph is a run of words of one document between content-defined cuts: a word
whose hash (with the word before it) is the least of the ``REACH`` words on either
side starts a new one. Newlines are white space like any other. So a passage falls
into the same paragraphs wherever it stands and however it is wrapped. Paragraphs that share a band
of their MinHash signature meet in tiles, their five-word shingle sets are
compared exactly, and connected paragraphs form a class. The first occurrence of
a class stays, the others are marked for removal.

Every occurrence of one content is counted once per task before the shuffle; a
band with many different contents is split into tiles, of which all pairs are
compared inside tasks. Nothing is capped.

Defined results: null text counts as empty; words are lower-cased in A-Z;
documents under ``MIN_WORDS`` words are left alone, and so are marked runs under
``MIN_RUN`` words of one document; repeats within one document alone are no class;
rows equal in ``doc_id`` and text are one document; a null ``doc_id`` sorts last
and is carried along; an empty table gives no rows; other columns are ignored by
``repeated`` and kept by ``cleaned``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aridscape.llm.common import boxed, components, written
from aridscape.llm.simhash import exact_links
from aridscape.llm.words import _powers, mixed, slices, windows

REACH = 6
WIDTH = 5
MIN_WORDS = 6
MIN_RUN = 12
TILE = 512


def tuned_bands(similarity: float = 0.8, recall: float = 0.98, most: int = 4) -> tuple[int, int]:
    """Bands and rows: the most rows per band with which at most ``most`` bands
    find a pair of the given similarity with the given probability."""
    rows = 1
    while math.ceil(math.log(1 - recall) / math.log(1 - similarity ** (rows + 1))) <= most:
        rows += 1
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


class Paragraphs:
    """Paragraphs of a slice of texts: ``first`` and ``stop`` word, row, content hash, shingles."""

    def __init__(self, s):
        self.slice = s
        n = len(s.starts)
        self.words = s.hashes(lower=True)
        before = np.zeros(n, np.uint64)
        before[1:] = np.where(s.row[1:] == s.row[:-1], self.words[:-1], np.uint64(0))
        value = mixed(self.words + before * np.uint64(3))
        least = np.ones(n, bool)
        for k in range(1, REACH + 1):
            same = s.row[k:] == s.row[:-k]
            least[k:] &= ~same | (value[k:] < value[:-k])
            least[:-k] &= ~same | (value[:-k] <= value[k:])
        # a document begins a paragraph, and no cut leaves less than MIN_WORDS at its ends
        fresh = np.ones(n, bool)
        fresh[1:] = s.row[1:] != s.row[:-1]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, n))
        inside = np.arange(n) - np.repeat(begin, size)
        cut = fresh | (least & (inside >= MIN_WORDS) & (np.repeat(size, size) - inside >= MIN_WORDS))
        self.first = np.flatnonzero(cut)
        self.stop = np.append(self.first[1:], n)
        long = self.stop - self.first >= MIN_WORDS
        self.position = np.arange(len(self.first))[long]
        self.first, self.stop = self.first[long], self.stop[long]
        self.row = s.row[self.first] if n else self.first
        power, inverse = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * power[:n])])
        self.content = mixed((sums[self.stop] - sums[self.first]) * inverse[self.first] + (self.stop - self.first).astype(np.uint64))

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes, and where each paragraph's begin (at least two each)."""
        owner = np.zeros(len(self.words) + 1, np.int64)
        owner[self.first] += 1
        owner = np.cumsum(owner)[:-1]
        inside = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(inside, self.first, 1)
        np.add.at(inside, self.stop, -1)
        owner[np.cumsum(inside)[:-1] == 0] = -1
        at, hashes = windows(self.words, owner, WIDTH)
        held = owner[at] >= 0
        at, hashes = at[held], hashes[held]
        return hashes, np.searchsorted(at, self.first)

    def band_keys(self, bands: int, rows: int) -> np.ndarray:
        hashes, begin = self.shingles()
        keys = np.zeros((bands, len(self.first)), np.uint64)
        if not len(self.first):
            return keys
        for b in range(bands):
            for r in range(rows):
                k = b * rows + r + 1
                factor = np.uint64((k * 0x9E3779B97F4A7C15 * 2 + 1) % 2**64)
                least = np.minimum.reduceat((hashes ^ np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)) * factor, begin)
                keys[b] = mixed(keys[b] + least + np.uint64(b + 1))
        return keys


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``key, content, n``: per some 50,000 paragraphs and content one row with its own hash as key
    and its number of occurrences, and one with each band's key (n = 0)."""

    def rows_of(contents, keys):
        content, at, n = np.unique(np.concatenate(contents), return_index=True, return_counts=True)
        band = np.concatenate(keys, axis=1)[:, at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([content, *band]).view(np.int64)),
                pa.array(np.tile(content, bands + 1).view(np.int64)),
                pa.array(np.concatenate([n, np.zeros(len(content) * bands, np.int64)]).astype(np.int32)),
            ],
            ["key", "content", "n"],
        )

    def run(batches):
        for batch in batches:
            contents, keys, held = [], [], 0
            for s in slices(batch.column(0)):
                p = Paragraphs(s)
                contents.append(p.content)
                keys.append(p.band_keys(bands, rows))
                held += len(p.content)
                if held > 50_000:
                    yield rows_of(contents, keys)
                    contents, keys, held = [], [], 0
            if contents:
                yield rows_of(contents, keys)

    return docs.select("text").mapInArrow(run, "key long, content long, n int")


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every paragraph: document, position, code-point span, words, content."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                p = Paragraphs(s)
                points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80, dtype=np.int64)])
                base = points[s.offsets[p.row]] if len(p.row) else p.row
                take = pa.array(p.row + s.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("text_hash").take(take),
                        pa.array(p.position.astype(np.int64)),
                        pa.array((points[s.starts[p.first]] - base).astype(np.int64)),
                        pa.array((points[s.ends[p.stop - 1]] - base).astype(np.int64)),
                        pa.array((p.stop - p.first).astype(np.int64)),
                        pa.array(p.content.view(np.int64)),
                    ],
                    ["doc_id", "text_hash", "position", "start", "stop", "n_words", "content"],
                )

    schema = "doc_id long, text_hash long, position long, start long, stop long, n_words long, content long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``content, shingles`` (sorted hashes) of the paragraphs at ``places``."""
    spans = places.groupBy("doc_id", "text_hash").agg(F.collect_list("content").alias("contents"))
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    both = keyed.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("text", "contents")

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            out_content, out_set = [], []
            for s in slices(batch.column(0)):
                p = Paragraphs(s)
                hashes, begin = p.shingles()
                end = begin + np.maximum(p.stop - p.first - WIDTH + 1, 1)
                content = p.content.view(np.int64)
                for r in range(s.rows):
                    mine = set(wanted[s.first + r].as_py())
                    lo, hi = np.searchsorted(p.row, [r, r + 1])
                    for k in range(lo, hi):
                        c = int(content[k])
                        if c in mine:
                            mine.discard(c)
                            out_content.append(c)
                            out_set.append(np.unique(hashes[begin[k] : end[k]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out_content, pa.int64()), pa.array(out_set, pa.list_(pa.int64()))], ["content", "shingles"])

    return both.mapInArrow(run, "content long, shingles array<long>").dropDuplicates(["content"])


def _links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: spanning links of contents that share a band and reach the similarity."""
    named = members.select("key", F.col("content").alias("node"))
    return exact_links(named, sets.withColumnRenamed("content", "node"), similarity, TILE)


def repeated(docs: DataFrame, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """``doc_id, text_hash, start, stop, n_words, class_id, n_documents, removed``:
    every paragraph that a class of at least two documents holds.

    ``start`` and ``stop`` are code points; ``class_id`` is the class's smallest
    content hash; all but the first occurrence (by ``doc_id``, text, place) are removed.
    """
    bands, rows = tuned_bands(similarity, recall)
    by_key = Window.partitionBy("key")
    seen = _signatures(docs, bands, rows).select(
        "key", "content", "n", F.sum("n").over(by_key).alias("total"), F.min("content").over(by_key).alias("low"), F.max("content").over(by_key).alias("high")
    )
    seen = written(seen.where("total > 1 OR low <> high").select("key", "content", "total"), "seen")
    members = seen.where("total = 0").select("key", "content").distinct()
    needed = seen.select("content").distinct()
    places = written(_occurrences(docs).join(needed, "content", "left_semi"), "places")
    several = seen.where("total = 0").select("content").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "start")).alias("first")
    reps = places.join(several, "content", "left_semi").groupBy("content").agg(first).select("content", "first.doc_id", "first.text_hash")
    sets = written(_shingle_sets(docs, reps), "sets")
    roots = components(_links(members, sets, similarity)).select(F.col("node").alias("content"), F.col("root"))
    placed = written(places.join(roots, "content", "left").withColumn("class_id", F.coalesce("root", "content")).drop("root"), "classes")
    document = F.struct("doc_id", "text_hash")
    classes = placed.groupBy("class_id").agg(
        F.count_distinct(document).alias("n_documents"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")).alias("first")
    ).where("n_documents > 1")
    found = placed.join(classes, "class_id")
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    # marked paragraphs that follow each other form a run
    run = F.sum(F.when(F.col("position") - F.lag("position").over(own) == 1, 0).otherwise(1)).over(own)
    found = found.withColumn("run", run)
    found = found.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "run")))
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")
    return found.where(F.col("run_words") >= MIN_RUN).select(
        "doc_id", "text_hash", "start", "stop", "n_words", "class_id", "n_documents", (~here.eqNullSafe(F.col("first"))).alias("removed")
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given code-point spans and the blank that each leaves."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if text[stop : stop + 1] == " ":
            stop += 1
        out.append(text[at:start])
        at = stop
    out.append(text[at:])
    return "".join(out)


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with removed spans cut out of their texts (and ``n_chars``, if
    there, set anew); documents of which no word is left go."""
    spans = repeated(docs, **options).where("removed")
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    rows = boxed(docs, k_id=F.col("doc_id").cast("long"), k_hash=F.xxhash64("text"))
    both = rows.join(spans, F.col("k_id").eqNullSafe(F.col("_id")) & (F.col("k_hash") == F.col("_hash")), "left").select("row", "_spans")

    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        return pd.Series([None if s is None else without_spans(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, lists)])

    marked = F.col("_spans").isNotNull()
    both = both.withColumn("_text", cut(F.when(marked, F.col("row.text")), "_spans"))
    both = both.where(~marked | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    columns = [F.when(marked, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    return both.select(*columns)
