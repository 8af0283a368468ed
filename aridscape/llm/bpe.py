"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are stable: encoded together, they come out as these two. So a
nondeterministic transducer reads bytes along the vocabulary's trie and, at the
end of a token that is stable behind the one before, may write it and go back to
the root. Every prefix of a text has one encoding, hence a set of hypotheses
(tokens not yet written, place in the trie) with at most one hypothesis for each
place where the last token can have begun. These sets are the states of the
deterministic machine. A step writes the tokens that all hypotheses share; the
rest waits for more bytes. States and steps are made when a text first asks for
them, and kept.

The order of merges enters through stability alone, which is found by undoing
merges on both sides of the border from the latest to the earliest. Any input
costs time in proportion to its bytes, also a match of a million letters.

Decoding takes ids in pieces and hands out bytes as far as the last whole
character, by a state machine over UTF-8 whose step for each whole token is
tabulated.

Defined cases: null and empty texts have no ids; repeated rows are encoded each;
further columns are ignored; bytes that are not UTF-8 pass decoding unchanged,
ill-formed parts counting as characters of their own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aridscape.llm import tokens

#: States kept by a process; beyond it the machine is built anew from the next match on.
STATES = 200_000
#: Rows handed on at once, and ids decoded at once.
ROWS = 256
PIECE = 1 << 16


class Merges:
    """Vocabulary as bytes per id, and what follows from the order of merges."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.rank = vocabulary
        self.bytes = {i: t for t, i in vocabulary.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if it has one byte,
        or if merging its bytes ends otherwise (such a token is never written)."""
        if token in self._parts:
            return self._parts[token]
        row = [bytes([b]) for b in self.bytes[token]]
        last = None
        while len(row) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(row, row[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            last = (row[i], row[i + 1])
            row[i : i + 2] = [row[i] + row[i + 1]]
        found = (self.rank[last[0]], self.rank[last[1]]) if last and len(row) == 1 else None
        self._parts[token] = found
        return found

    def reachable(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.parts(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Whether the border between two tokens survives when both are encoded together."""
        known = self._stable.get((left, right))
        if known is not None:
            return known
        x, y, before = left, right, None
        stable = True
        while True:
            across = self.rank.get(self.bytes[x] + self.bytes[y])
            if across is not None and (before is None or across < before):
                stable = False
                break
            undo_x, undo_y = self.parts(x), self.parts(y)
            if undo_x is None and undo_y is None:
                break
            # of two equal merges the left one comes first, so the right one is undone first;
            # a merge across is left of a merge inside y and wins a tie against it
            if undo_y is None or (undo_x is not None and x > y):
                before, x = x, undo_x[1]
            else:
                before, y = y + 1, undo_y[0]
        self._stable[left, right] = stable
        return stable


class Transducer:
    """Deterministic machine over bytes, built as it is used."""

    def __init__(self, merges: Merges, most_states: int = STATES):
        self.merges = merges
        self.most_states = most_states
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        for text, token in merges.rank.items():
            node = 0
            for b in text:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = token
        self._reset()

    def _reset(self) -> None:
        self.state: dict[tuple, int] = {}
        self.meaning: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rest: list[tuple[int, ...]] = []
        self._number((-1, (((), 0),)))

    def _number(self, meaning: tuple) -> int:
        """Number of a state (last token written, hypotheses)."""
        number = self.state.get(meaning)
        if number is None:
            number = self.state[meaning] = len(self.meaning)
            self.meaning.append(meaning)
            self.steps.append({})
            self.rest.append(next((waiting for waiting, node in meaning[1] if node == 0), None))
        return number

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and the tokens written on a byte not met in this state so far."""
        written, hypotheses = self.meaning[state]
        found = []
        for waiting, node in hypotheses:
            to = self.next[node].get(byte)
            if to is None:
                continue
            if self.next[to]:
                found.append((waiting, to))
            token = self.token[to]
            if token >= 0 and self.merges.reachable(token):
                last = waiting[-1] if waiting else written
                if last < 0 or self.merges.stable(last, token):
                    found.append(((*waiting, token), 0))
        if not found:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        shared = 0
        shortest = min(len(w) for w, _ in found)
        while shared < shortest and len({w[shared] for w, _ in found}) == 1:
            shared += 1
        out = found[0][0][:shared]
        left = tuple((w[shared:], node) for w, node in found)
        last = out[-1] if out else written
        step = (self._number((last if any(not w for w, _ in left) else -1, left)), out)
        self.steps[state][byte] = step
        return step

    def encode(self, match: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if len(self.meaning) > self.most_states:
            self._reset()
        steps, state, out = self.steps, 0, []
        for byte in match:
            step = steps[state].get(byte)
            if step is None:
                step = self._step(state, byte)
            state, tokens_out = step
            if tokens_out:
                out += tokens_out
        out += self.rest[state]
        if len(out) > 1:
            # a match that is itself an entry is taken whole, even one that no merges lead to
            whole = self.merges.rank.get(match)
            if whole is not None:
                return [whole]
        return out


class Encoder(tokens.Encoder):
    """Ids of whole columns; each distinct piece passes the transducer once.

    A piece is white space and the word behind it, so no match of the pattern
    crosses its ends (see ``tokens``)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.machine = Transducer(self.merges)
        self.matches = regex.compile(pattern).findall
        self.dtype = np.uint16 if max(self.merges.bytes) < 1 << 16 else np.uint32
        self.drops_space = False
        self._forget()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode, flat, counts = self.machine.encode, [], []
        for text in texts:
            before = len(flat)
            for match in self.matches(text):
                flat += encode(match.encode("utf-8", "replace"))
            counts.append(len(flat) - before)
        return np.array(flat, self.dtype), np.array(counts, np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _utf8_steps() -> np.ndarray:
    """Step table [state, byte] of UTF-8. State 0: at a border; 1 to 3: so many
    more bytes; 4 to 7: the next byte is limited; 8: ill-formed."""
    steps = np.full((9, 256), 8, np.uint8)
    steps[0, :0x80] = 0
    steps[0, 0xC2:0xE0] = 1
    steps[0, 0xE0:0xF0] = 2
    steps[0, 0xF0:0xF5] = 3
    steps[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        steps[state, low:high] = to
    return steps


class Vocabulary:
    """Bytes of all tokens side by side, and each token's step from each UTF-8 state."""

    def __init__(self, merges: Merges):
        size = max(merges.bytes) + 1
        texts = [merges.bytes.get(i, b"") for i in range(size)]
        self.length = np.fromiter(map(len, texts), np.int64, size)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_steps = _utf8_steps()
        self.steps = np.tile(np.arange(9, dtype=np.uint8), (size, 1))
        for k in range(int(self.length.max(initial=0))):
            has = np.flatnonzero(self.length > k)
            self.steps[has] = self.byte_steps[self.steps[has], self.data[self.first[has] + k][:, None]]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        return self.data[np.arange(total) + np.repeat(self.first[ids] - upto + length, length)]


class StreamDecoder:
    """Bytes of ids that arrive in pieces, handed out up to the last whole character."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        data = self.held + v.bytes_of(ids).tobytes()
        # only tokens that leave a character open, and those up to its end, are stepped through
        opens = np.flatnonzero(v.steps[ids, 0]).tolist()
        at, state = 0, self.state
        for i in ([0] if state and len(ids) else []) + opens:
            if i < at:
                continue
            at = i
            while at < len(ids):
                state = int(v.steps[ids[at], state])
                at += 1
                if state in (0, 8):
                    break
            if state == 8:
                break
        self.state = state
        if state == 8:
            return self._ill_formed(data)
        held = 0
        if state:
            held = next(k for k in (1, 2, 3) if data[-k] >= 0xC0)
        self.held = data[len(data) - held :]
        return data[: len(data) - held]

    def _ill_formed(self, data: bytes) -> bytes:
        """Byte by byte: an ill-formed part ends before the byte that breaks it."""
        state, begin, steps = 0, 0, self.vocabulary.byte_steps
        for i, b in enumerate(data):
            if state == 0:
                begin = i
            to = int(steps[state, b])
            if to == 8 and state:
                begin, to = i, int(steps[0, b])
            state = 0 if to == 8 else to
        self.state = state
        cut = begin if state else len(data)
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        """What is left of an unfinished last character."""
        left, self.held, self.state = self.held, b"", 0
        return left


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path, pattern)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(Merges(read_ranks(path)))


def decoded(ids: np.ndarray, v: Vocabulary) -> Iterator[bytes]:
    """Decoded bytes of a document in pieces that end with a character."""
    stream = StreamDecoder(v)
    for at in range(0, len(ids), PIECE):
        yield stream.feed(ids[at : at + PIECE])
    yield stream.finish()


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for keys, texts in _parts(batch):
                ids, bounds = encoder(path, pattern).encode(texts)
                raw = ids.astype("<u4").tobytes()
                rows = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows, pa.binary())], ["doc_id", "ids"])

    rows = _texts(docs, key, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded_texts(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``encoded`` rows; ill-formed parts become U+FFFD."""

    def run(batches):
        for batch in batches:
            for keys, column in _parts(batch):
                texts = ["".join(p.decode("utf-8", "replace") for p in decoded(np.frombuffer(x or b"", "<u4"), vocabulary(path))) for x in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and then decoding each text."""

    def run(batches):
        for batch in batches:
            for keys, texts in _parts(batch):
                ids, bounds = encoder(path, pattern).encode(texts)
                of_ids, of_bytes = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    row = ids[a:b].astype("<u4")
                    of_ids.append(hashlib.sha256(row.tobytes()).hexdigest())
                    digest = hashlib.sha256()
                    for piece in decoded(row, vocabulary(path)):
                        digest.update(piece)
                    of_bytes.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = _texts(docs, key, text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema)
