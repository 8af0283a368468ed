import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aridscape.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")
TRICKY = ["", " ", "  a b  ", "a\xa0\n b", "it's we'll", "<|endoftext|>", "-" * 300, "ab" * 2000, "漢字漢字", "😀😀x", "\x1c\x1f\x85", "é" * 999, "٣٤ 12", None]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def merged(text: bytes, rank: dict[bytes, int]) -> list[int]:
    row = [bytes([b]) for b in text]
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(row, row[1:])) if a + b in rank), default=None)
        if best is None:
            return [rank[t] for t in row]
        row[best[1] : best[1] + 2] = [row[best[1]] + row[best[1] + 1]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_small_vocabularies_equal_plain_merging(seed):
    """Random merges over three letters, ties and overlaps included."""
    r = random.Random(seed)
    entries = [b"a", b"b", b"c"]
    while len(entries) < 20:
        new = r.choice(entries) + r.choice(entries)
        if new not in entries and len(new) < 9:
            entries.append(new)
    rank = {t: i for i, t in enumerate(entries)}
    machine = bpe.Transducer(bpe.Merges(rank), most_states=r.choice([3, 1000]))
    for _ in range(40):
        text = bytes(r.choice(b"abc") for _ in range(r.randrange(40)))
        expected = [rank[text]] if text in rank else merged(text, rank)
        assert machine.encode(text) == expected


def test_an_entry_no_merges_lead_to_is_taken_whole_only():
    rank = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4, b"ab": 5}
    machine = bpe.Transducer(bpe.Merges({**rank, b"cab": 6, b"ca": 7}))
    assert machine.encode(b"cab") == [6]
    assert machine.encode(b"cabb") == merged(b"cabb", {**rank, b"cab": 6, b"ca": 7})


def test_ids_equal_the_library(plain):
    r = random.Random(2)
    pieces = ["a", "the", "é", " ", "  ", "\n", "\t", "\xa0", "12", "!", "'s", "—", "漢", "　", "\x1f", " ", "İ", "😀"]
    texts = TRICKY + ["".join(r.choice(pieces) for _ in range(r.randrange(25))) for _ in range(800)]
    import pyarrow as pa

    ids, bounds = bpe.encoder(PATH, public.PATTERN).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode_ordinary(text or ""), repr(text)


def test_output_waits_for_few_bytes(plain):
    """Lookahead is bounded: a hypothesis dies where the trie ends."""
    machine = bpe.encoder(PATH, public.PATTERN).machine
    longest = max(map(len, machine.merges.rank))
    machine.encode(("wahrscheinlich" * 400).encode())
    waiting = max(sum(len(machine.merges.bytes[t]) for t in w) for _, hypotheses in machine.meaning for w, _ in hypotheses)
    assert waiting <= 2 * longest


def test_pieces_of_a_stream_end_with_characters():
    v = bpe.vocabulary(PATH)
    merges = bpe.Merges(bpe.read_ranks(PATH))
    single = {t: i for t, i in merges.rank.items() if len(t) == 1}
    r = random.Random(5)
    for k in range(300):
        text = "".join(r.choice("aé漢😀") for _ in range(r.randrange(12))).encode()
        if k % 2:
            text = bytes(r.choice([0x61, 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x80, 0xFF]) for _ in range(r.randrange(14)))
        ids = np.array([single[bytes([b])] for b in text], np.int64)
        stream, at, out = bpe.StreamDecoder(v), 0, []
        while at < len(ids):
            to = at + r.randrange(1, 4)
            out.append(stream.feed(ids[at:to]))
            at = to
        out.append(stream.finish())
        assert b"".join(out) == text
        assert "".join(p.decode("utf-8", "replace") for p in out) == text.decode("utf-8", "replace")


def test_digests_and_round_trip(spark, documents, plain):
    docs = documents([(i, t, "de", "s") for i, t in enumerate([*TRICKY, "lang " * 60_000, "x" * 200_000, "same", "same"])])
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, public.PATTERN).collect()}
    rows = bpe.encoded(docs, PATH, public.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decoded_texts(rows, PATH).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    assert back == texts
    for i, text in texts.items():
        ids = plain.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, public.PATTERN).count() == 0
