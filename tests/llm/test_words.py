import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aridscape.llm.words import slices, windows

ALPHABET = ["a", "B", "é", "漢", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", ".", "9"]
texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts, st.sampled_from([1, 7, 1 << 20]))
def test_words_of_slices(rows, size):
    got = [[] for _ in rows]
    hashes = {}
    for s in slices(pa.array(rows, pa.string()), size):
        for b, e, r, h in zip(s.starts, s.ends, s.row, s.hashes()):
            word = s.data[b:e].tobytes().decode()
            got[s.first + r].append(word)
            assert hashes.setdefault(word, h) == h
        assert np.diff(s.bounds).sum() == len(s.starts)
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    assert len(set(hashes.values())) == len(hashes)


def test_windows_stay_in_their_row():
    at, found = windows(np.array([1, 2, 1, 2, 1, 2], np.uint64), np.array([0, 0, 0, 1, 1, 1]), 2)
    assert at.tolist() == [0, 1, 3, 4]
    assert found[0] == found[3] and found[1] == found[2] and found[0] != found[1]
    assert len(windows(np.zeros(1, np.uint64), np.zeros(1, np.int64), 2)[0]) == 0


@pytest.mark.parametrize("name, drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_tokenizer(name, drops_space):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from aridscape.llm.tokens import Encoder

    r = random.Random(3)
    pieces = ["a", "the", "é", " ", "  ", "\n", "\t", "\xa0", " ", "12", "!", "'s", "—", "漢", "　", "\x1f", "İ", "<|endoftext|>"]
    rows = [None, "", " ", "  a b  "] + ["".join(r.choice(pieces) for _ in range(r.randrange(25))) for _ in range(600)]
    plain = tokenizers.Tokenizer.from_file(public.path(name))
    plain.encode_special_tokens = True
    ids, bounds = Encoder(public.path(name), drops_space).encode(pa.array(rows))
    for i, text in enumerate(rows):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_ids_where_letters_digits_and_signs_meet():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from aridscape.llm.tokens import MARK, Encoder

    r = random.Random(5)
    pieces = ["a", "Bc", "é", "e\u0301", "'", "'s", "'S", "'re", ".", "--", "…", "5", "½", " ", "\n", "<", "\u0338", MARK, "\x00", "İ", "Σ", "\u200d"]
    rows = ["".join(r.choices(pieces, k=r.randrange(14))) for _ in range(4000)]
    path = public.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids, bounds = Encoder(path, True).encode(pa.array(rows))
    want = [e.ids for e in plain.encode_batch_fast(rows, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
