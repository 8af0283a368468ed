"""Alignment of two tokenizers over the same text, by anchors at white space.

Both tokenizers encode the whole text. A place is an anchor if tokens of both
sides begin there with a space: the tokens before it end together, which the
byte offsets verify. Anchors cut a document into windows, hardly longer than a
word, and a window's alignment depends on its token ids alone. So it is worked
out once for each pair of id tuples and kept; a document's alignment is that of
its windows one behind the other.

Inside a window, tokens that end at the same byte close a group and link the two
tokens that end there. Linked tokens end with the same bytes, so one's bytes are
a suffix of the other's: a vocabulary pair has no more distinct links than
``most_links`` counts (some 10^5 for the public files), whatever the corpus.
That bounds the table of corpus-wide counts, which goes to every task.

Defined cases: null and empty texts, and texts that one side does not return
byte for byte, have no tokens: counts are zero and the digest is ''. Repeated
rows count each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.llm import tokens
from aridscape.llm.common import written
from aridscape.llm.words import mixed, text_buffers

#: Windows of a generation of the memo (see ``tokens.KEPT``).
KEPT = 250_000
#: Rows and bytes worked off at once.
ROWS = 256
BLOCK_BYTES = 2 << 20
_SHIFT = 20
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class TokenBytes:
    """Bytes of all tokens of a vocabulary side by side."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in texts), bool, len(texts))

    def of(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        return self.data[np.arange(total) + np.repeat(self.first[ids] - upto + length, length)]


def byte_level_vocabulary(path: str) -> TokenBytes:
    """Entries of a byte-level tokenizers file. Its alphabet shows printable Latin-1
    characters as themselves and the other bytes, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    texts: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in parsed["model"]["vocab"].items() if all(c in byte for c in t)}
    texts |= {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
    return TokenBytes([texts.get(i, b"\xff") for i in range(max(texts) + 1)])


def piece_vocabulary(model) -> TokenBytes:
    """Pieces of a sentencepiece model: U+2581 is a space, byte pieces are their byte."""

    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return TokenBytes([of(i) for i in range(model.get_piece_size())])


def most_links(a: TokenBytes, b: TokenBytes) -> int:
    """Pairs of entries of which one's bytes are a suffix of the other's."""
    total = 0
    for x, y, proper in ((a, b, False), (b, a, True)):
        have: dict[bytes, int] = {}
        for t in y.texts:
            have[t] = have.get(t, 0) + 1
        total += sum(have.get(t[k:], 0) for t in x.texts for k in range(int(proper), len(t)))
    return total


class Aligner:
    """Both tokenizers, their vocabularies and the memo of a process."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_ids = tokens.encoder(a_path, False)
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = byte_level_vocabulary(a_path), piece_vocabulary(self.b_model)
        self.size_a, self.size_b = self.a.length.tolist(), self.b.length.tolist()
        self.name_a, self.name_b = ([f",{i}" for i in range(len(v.texts))] for v in (self.a, self.b))
        self.young: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
        self.old: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}

    def window(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        """Groups of a window as text, and its links as 64-bit codes."""
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.name_a, self.name_b
        groups, links, others = [], array("q"), iter(b)
        end_a = end_b = 0
        of_a = of_b = ""
        for t in a:
            of_a += name_a[t]
            end_a += size_a[t]
            while end_b < end_a:
                u = next(others)
                of_b += name_b[u]
                end_b += size_b[u]
            if end_a == end_b:
                groups.append(f"{of_a[1:]}|{of_b[1:]}")
                links.append((t << _SHIFT) + u)
                of_a = of_b = ""
        return ";".join(groups).encode(), links.tobytes()

    def _known(self, key: tuple[bytes, bytes], type_a: str, type_b: str) -> tuple[bytes, bytes]:
        found = self.young.get(key)
        if found is not None:
            return found
        found = self.old.get(key)
        if found is None:
            found = self.window(memoryview(key[0]).cast(type_a).tolist(), memoryview(key[1]).cast(type_b).tolist())
        if len(self.young) >= KEPT:
            self.old, self.young = self.young, {}
        self.young[key] = found
        return found

    def _tokens(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Token ids of the rows that both sides return byte for byte, each row's number
        of either, and which rows these are."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        offsets, data = text_buffers(spaced)
        a, a_bounds = self.a_ids.encode(spaced)
        plain = [data[s + 1 : e].tobytes().decode("utf-8", "replace") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        lists = self.b_model.encode(plain, num_threads=1)
        n_a, n_b = np.diff(a_bounds), np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int32, int(n_b.sum()))
        length = np.diff(offsets)
        row_a, row_b = np.repeat(np.arange(len(length)), n_a), np.repeat(np.arange(len(length)), n_b)
        good = length > 1
        for v, ids, row in ((self.a, a, row_a), (self.b, b, row_b)):
            good &= np.bincount(row, v.length[ids], len(length)).astype(np.int64) == length
        for v, ids, row in ((self.a, a, row_a), (self.b, b, row_b)):
            at = np.repeat(np.arange(len(length)), length)[np.repeat(good, length)]
            unlike = v.of(ids[good[row]]) != data[offsets[0] : offsets[-1]][np.repeat(good, length)]
            good[at[unlike]] = False
        return a[good[row_a]], b[good[row_b]], n_a * good, n_b * good, good

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        """Tokens of either side, groups and links (codes) of each text."""
        a, b, n_a, n_b, good = self._tokens(texts)
        # rows have the same bytes on both sides, so offsets run on over them
        start_a, start_b = (np.cumsum(v.length[ids]) - v.length[ids] for v, ids in ((self.a, a), (self.b, b)))
        mark_a, mark_b = np.flatnonzero(self.a.spaced[a]), np.flatnonzero(self.b.spaced[b])
        _, at_a, at_b = np.intersect1d(start_a[mark_a], start_b[mark_b], True, True)
        cut_a, cut_b = mark_a[at_a], mark_b[at_b]  # a row's first tokens begin with its space
        end_a, end_b = np.append(cut_a[1:], len(a)), np.append(cut_b[1:], len(b))
        # equal windows of the block are looked up once
        same = mixed(_ranges(a, cut_a, end_a) * _ODD + _ranges(b, cut_b, end_b))
        _, first, which = np.unique(same, return_index=True, return_inverse=True)
        raw_a, raw_b, w_a, w_b = a.tobytes(), b.tobytes(), a.itemsize, b.itemsize
        bounds = zip(*[(x[first] * w).tolist() for x, w in ((cut_a, w_a), (end_a, w_a), (cut_b, w_b), (end_b, w_b))])
        found = [self._known((raw_a[p:q], raw_b[r:s]), a.dtype.char, b.dtype.char) for p, q, r, s in bounds]
        groups, codes, which_list = [f[0] for f in found], [f[1] for f in found], which.tolist()
        window = np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(n_a)])).tolist()
        for row, (size_a, size_b, ok) in enumerate(zip(n_a.tolist(), n_b.tolist(), good.tolist())):
            mine = which_list[window[row] : window[row + 1]] if ok else []
            links = np.frombuffer(b"".join([codes[k] for k in mine]), np.int64)
            yield size_a, size_b, b";".join([groups[k] for k in mine]), links


_random = np.random.Generator(np.random.PCG64(11))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUE = _random.integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def _ranges(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ids (order counts)."""
    value = _VALUE[ids & 0xFFFF] + ids.astype(np.uint64)
    out = np.zeros(len(starts), np.uint64)
    length = ends - starts
    for k in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > k)
        if len(at) < 64:  # few long runs are left
            for i in at.tolist():
                h = int(out[i])
                for x in value[starts[i] + k : ends[i]].tolist():
                    h = (h * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
                out[i] = h
            break
        out[at] = out[at] * _ODD + value[starts[at] + k]
    return out * _ODD + length.astype(np.uint64)


def _blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of blocks of some ``most`` bytes (one row at least)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to - at
        at = to


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per process and pair of files."""
    return Aligner(a_path, b_path)


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted codes and their summed weights (1 by default)."""
    if weights is not None:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    if weights is None:
        return codes[first], np.diff(np.concatenate([first, [len(codes)]]))
    return codes[first], np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, times``: each
    document's distinct links (code = id of a * 2^20 + id of b, as little-endian
    64-bit integers) and how often each occurs; with ``groups`` also their text."""

    def run(batches):
        for batch in batches:
            for at, n in _blocks(batch.column(1)):
                keys = batch.column(0).slice(at, n)
                out = [[] for _ in range(8)]
                for n_a, n_b, text_of, codes in aligner(a_path, b_path).rows(batch.column(1).slice(at, n)):
                    links, times = _counted(np.sort(codes))
                    digest = hashlib.sha256(text_of).hexdigest() if n_a else ""
                    n = len(codes)
                    row = (n_a, n_b, n, n, digest, links.astype("<i8").tobytes(), times.astype("<i4").tobytes(), text_of)
                    for column, value in zip(out, row):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([keys, *columns[: 7 + groups]], names[: 8 + groups])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times", "groups"]
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    types = [rows.schema["doc_id"].dataType.simpleString(), "long", "long", "long", "long", "string", "binary", "binary", "string"]
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in list(zip(names, types))[: 8 + groups]))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links, times and each row's number of links of a batch of ``aligned`` rows."""
    links, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("links", "times"))
    per_row = np.fromiter((len(x) // 8 for x in links), np.int64, len(links))
    return np.frombuffer(b"".join(links), "<i8"), np.frombuffer(b"".join(times), "<i4").astype(np.int64), per_row


def link_counts(rows: DataFrame) -> DataFrame:
    """``link, count``: how many links of all documents of ``aligned`` hold each pair.
    Each task adds up its own before the shuffle."""

    def run(batches):
        links, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                more, times, _ = _arrays(batch.slice(at, ROWS))
                links, counts = _counted(np.concatenate([links, more]), np.concatenate([counts, times]))
        yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(counts)], ["link", "count"])

    parts = rows.select("links", "times").mapInArrow(run, "link long, count long")
    return parts.groupBy("link").agg(F.sum("count").alias("count"))


def statistics(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: see ``COLUMNS``. ``n_best`` counts links as frequent as
    their b id's most frequent one, ``count_sum`` adds all links' corpus-wide counts."""
    rows = written(aligned(docs, a_path, b_path, key, text), "aligned")
    table = link_counts(rows).toArrow()  # at most ``most_links`` rows
    link, count = table.column("link").to_numpy(), table.column("count").to_numpy()
    order = np.argsort(link)
    link, count = link[order], count[order]
    b_id = link & ((1 << _SHIFT) - 1)
    highest = np.zeros(int(b_id.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b_id, count)
    best = count == highest[b_id]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                links, times, per_row = _arrays(part)
                slot = np.searchsorted(link, links)

                def by_row(values):
                    upto = np.concatenate([[0], np.cumsum(values)])
                    ends = np.cumsum(per_row)
                    return pa.array(upto[ends] - upto[ends - per_row])

                columns = {n: part.column(part.schema.get_field_index(n)) for n in COLUMNS if n not in ("n_best", "count_sum")}
                columns |= {"n_best": by_row(times * best[slot]), "count_sum": by_row(times * count[slot])}
                yield pa.RecordBatch.from_arrays([columns[n] for n in COLUMNS], list(COLUMNS))

    key_type = rows.schema["doc_id"].dataType.simpleString()
    types = [key_type, "long", "long", "long", "long", "long", "long", "string"]
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(COLUMNS, types)))
