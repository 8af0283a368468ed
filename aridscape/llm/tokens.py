"""Token ids of whole Arrow columns by a tokenizers file.

Every distinct piece of text is encoded once and its ids are kept, so that
frequent words cost a look-up. Pieces end where the tokenizer itself always
splits: before white space that follows a character (byte-level vocabularies) or
at any white space (vocabularies that drop it).
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa

from aridscape.llm.words import Slice, slices

#: Entries of a generation. When the young one is full it becomes the old one; what
#: is used again moves back into the young one, so that frequent pieces stay known.
KEPT = 1_000_000
#: Texts per call of the tokenizer, whose results are large while they live.
CALL = 2048

#: Fixed value: the public pattern of vocabularies that split letters, digits and signs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: New pieces go to the tokenizer several in one text, each followed by this sign.
MARK = "\x01"
JOINED = 6

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0


class Store:
    """Ids of pieces by hash: sorted hashes, place and number of each piece's ids."""

    def __init__(self, dtype):
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, dtype)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if it isn't here."""
        slot = np.searchsorted(self.known, hashes)
        missing = slot == len(self.known)
        missing[~missing] = self.known[slot[~missing]] != hashes[~missing]
        slot[missing] = -1
        return slot

    def take(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots one behind the other, and how many each has."""
        length, place = self.length[slot], self.place[slot]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        return self.flat[np.arange(total) + np.repeat(place - upto + length, length)], length

    def add(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.place = np.concatenate([self.place, len(self.flat) + np.cumsum(length) - length])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    #: Pieces end where the kind of sign changes; A-Z counts as a-z; the id of MARK.
    by_kind = lower = False
    mark = None

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.drops_space = drops_space
        parts = json.loads(self.tokenizer.to_str())
        if drops_space and json.dumps(RUNS) in json.dumps(parts["pre_tokenizer"]):
            self.by_kind = True
            self.lower = '"Lowercase"' in json.dumps(parts["normalizer"])
            mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.young, self.old = Store(self.dtype), Store(self.dtype)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        flat, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), CALL):
            some = texts[at : at + CALL]
            joined = self.mark is not None and not any(MARK in t for t in some)
            if joined:
                gap = f" {MARK} "
                some = [gap.join(some[k : k + JOINED]) + gap for k in range(0, len(some), JOINED)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            length = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(length.sum()))
            if joined:
                ends = ids == self.mark
                length = np.diff(np.flatnonzero(ends), prepend=-1) - 1
                ids = ids[~ends]
            counts.append(length)
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(counts)

    def _pieces(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and row of the pieces of a slice."""
        if self.by_kind and len(s.starts):
            kind = _KIND[s.data]
            word = np.zeros(len(kind), bool)
            word[s.starts] = True
            cut = word.copy()
            cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            begin = np.flatnonzero(cut)
            of = np.cumsum(word[begin]) - 1
            return begin, np.minimum(s.ends[of], np.append(begin[1:], len(kind))), s.row[of]
        if self.drops_space:
            return s.starts, s.ends, s.row
        first = np.zeros(len(s.starts), bool)
        first[s.bounds[:-1][np.diff(s.bounds) > 0]] = True
        begin = np.concatenate([[0], s.ends[:-1]]) if len(s.ends) else s.ends
        begin = np.where(first, s.offsets[s.row], begin)
        # white space behind the last word of a row, or a row of nothing else
        last = s.offsets[:-1].copy()
        filled = np.diff(s.bounds) > 0
        last[filled] = s.ends[s.bounds[1:][filled] - 1]
        tail = np.flatnonzero(last < s.offsets[1:])
        begin, end = np.concatenate([begin, last[tail]]), np.concatenate([s.ends, s.offsets[1:][tail]])
        row = np.concatenate([s.row, tail])
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], row[order]

    def _wide_space(self, s: Slice) -> np.ndarray:
        """Rows with white space beyond ASCII, which may join an ASCII run."""
        d = s.data
        if self.drops_space or len(d) < 2:
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3))
        lead = lead[lead + 1 < len(d)]
        b0, b1, b2 = d[lead], d[lead + 1], d[np.minimum(lead + 2, len(d) - 1)]
        space = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        space |= (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
        space |= (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
        space |= (b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)
        space |= (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
        return np.unique(np.searchsorted(s.offsets, lead[space], "right") - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column and each row's first place among them (and the end)."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for s in slices(column, 2 << 20):
            begin, end, row = self._pieces(s)
            direct = self._wide_space(s)
            if len(direct):
                plain = ~np.isin(row, direct)
                begin, end, row = begin[plain], end[plain], row[plain]
            hashes, at, inverse = np.unique(s.hashes(begin, end, self.lower), return_index=True, return_inverse=True)
            if len(self.young.known) > KEPT:
                self.old, self.young = self.young, Store(self.dtype)
            slot = self.young.find(hashes)
            missing = np.flatnonzero(slot < 0)
            if len(missing):
                in_old = self.old.find(hashes[missing])
                used, new = missing[in_old >= 0], missing[in_old < 0]
                old_flat, old_length = self.old.take(in_old[in_old >= 0])
                texts = [s.data[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(begin[at[new]].tolist(), end[at[new]].tolist())]
                flat, length = self._ids(texts)
                self.young.add(np.concatenate([hashes[used], hashes[new]]), np.concatenate([old_flat, flat]), np.concatenate([old_length, length]))
                slot = self.young.find(hashes)
            out, length = self.young.take(slot[inverse])
            count = np.bincount(row, length, s.rows).astype(np.int64)
            if len(direct):
                parts = np.split(out, np.cumsum(count)[:-1])
                for r in direct.tolist():
                    parts[r], _ = self._ids([s.data[s.offsets[r] : s.offsets[r + 1]].tobytes().decode("utf-8", "replace")])
                    count[r] = len(parts[r])
                out = np.concatenate(parts)
            ids.append(out)
            counts.append(count)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


@functools.lru_cache(4)
def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path, drops_space)
