import heapq
import random

import numpy as np
import pytest

from aridscape.llm import huffman
from aridscape.llm.common import scratch_path

from .conftest import prose


def plain_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_lengths_are_optimal_and_limited():
    r = np.random.default_rng(0)
    for n in (2, 3, 30, 400):
        counts = (r.pareto(0.7, n) * 3).astype(np.int64) + (np.arange(n) % 3 > 0)
        counts[:2] = 1
        lengths = huffman.code_lengths(counts, 20)
        assert ((lengths > 0) == (counts > 0)).all()
        used = lengths[lengths > 0].astype(int)
        assert sum(2.0**-x for x in used) == 1
        if plain_cost(counts) and used.max() < 20:
            assert int((counts * lengths).sum()) == plain_cost(counts)
        tight = huffman.code_lengths(counts, int(np.ceil(np.log2((counts > 0).sum()))) + 1)
        assert tight.max() <= np.ceil(np.log2((counts > 0).sum())) + 1 and sum(2.0**-int(x) for x in tight if x) <= 1
        codes = [format(int(c), f"0{int(b)}b") for c, b in zip(huffman.canonical_codes(lengths), lengths) if b]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_bits_round_trip():
    r = np.random.default_rng(1)
    counts = np.bincount((r.pareto(1, 5000) * 5).astype(np.int64).clip(0, 999), minlength=1000)
    lengths = huffman.code_lengths(counts)
    sizes = [1, 128, 129, 1000, 3, 256]
    ids = r.choice(np.flatnonzero(counts), sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    packed, begin, inside = huffman.encode_documents(ids, bounds, huffman.canonical_codes(lengths), lengths)
    table = huffman.decode_table(lengths)
    for d, n in enumerate(sizes):
        data = packed[begin[d] : begin[d + 1]]
        marks = inside[bounds[d] : bounds[d + 1] : huffman.CHECKPOINT]
        count = np.minimum(huffman.CHECKPOINT, n - huffman.CHECKPOINT * np.arange(len(marks)))
        assert (huffman.decode_lanes(data, marks, count, table) == ids[bounds[d] : bounds[d + 1]]).all()


def test_files_round_trip(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(i * 3 % 101, prose(i, i % 70), "en", "a") for i in range(101)] + [(200, None, "en", "a"), (None, "x", "en", "a"), (5, "again", "en", "a"), (300, prose(3, 9000), "en", "a")]
    random.Random(2).shuffle(rows)
    out = f"{scratch_path(spark, 'test')}/files"
    huffman.write(documents(rows).repartition(5), out, path, True, 2, part_ids=4000)
    got = huffman.read(spark, out).collect()
    model = tokenizers.Tokenizer.from_file(path)
    want = {}
    for i, t, _, _ in rows:
        want.setdefault(i, []).append(model.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        want[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
        at += r.n_tokens
    assert not any(want.values())
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    empty = f"{scratch_path(spark, 'test')}/files"
    huffman.write(documents([]), empty, path, True, 2)
    assert huffman.read(spark, empty).count() == 0
