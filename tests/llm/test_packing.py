import random

import numpy as np
import pytest

from aridscape.llm import packing

from .conftest import prose


def test_tournament_equals_plain_first_fit():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted((r.randrange(1, 101) for _ in range(n)), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, x in enumerate(room) if x >= s), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= s
            want.append(at)
        assert packing.first_fit(sizes, 100) == want


def test_every_id_lies_in_one_piece():
    r = np.random.default_rng(2)
    for lengths in (r.integers(1, 300, 200), np.array([100]), np.array([250]), np.array([1] * 5), np.array([99, 99, 99]), np.zeros(0, np.int64)):
        out = packing.pack_lengths(lengths, 100)
        seen = [np.zeros(n, int) for n in lengths]
        bins = {}
        for d, start, n, b, offset in out:
            assert n > 0
            seen[d][start : start + n] += 1
            bins.setdefault(b, []).append((offset, n))
        assert all((s == 1).all() for s in seen)
        for pieces in bins.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 100
        assert len(bins) <= -(-int(lengths.sum()) // 100) + 1


def test_pieces_hold_the_ids(documents):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(i, prose(i, 5 + 40 * (i % 9)), "en", "a") for i in range(60)] + [(70, None, "en", "a"), (71, prose(7, 3000), "en", "a"), (None, "a b", "en", "a"), (3, rows_3(), "en", "a")]
    rows += [rows[5]]
    out = packing.packed(documents(rows), path, group_rows=20, length=256).collect()
    model = tokenizers.Tokenizer.from_file(path)
    texts = sorted(tuple(model.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _, _ in rows)
    pieces = {}
    for p in out:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    total = sum(len(t) for t in texts)
    assert sum(p.length for p in out) == total
    for (doc_id, n), parts in pieces.items():
        starts = {}
        for start, ids in parts:
            starts.setdefault(start, []).append(ids)
        if all(len(v) == 1 for v in starts.values()):
            whole = np.concatenate([starts[s][0] for s in sorted(starts)])
            assert tuple(whole.tolist()) in texts and len(whole) == n
    used = {}
    for p in sorted(out, key=lambda p: p.offset):
        assert used.get(p.sequence_id, 0) == p.offset
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= 256
    again = packing.packed(documents(rows[::-1]).repartition(5), path, group_rows=20, length=256).collect()
    key = lambda p: (p.sequence_id, p.offset, p.doc_id or -1, p.start, bytes(p.ids))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert packing.packed(documents([]), path).count() == 0


def rows_3():
    return "  odd \n white  space "
