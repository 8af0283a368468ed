import hashlib
from collections import Counter

import pytest

from aridscape.llm import crosstok

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")

TEXTS = [
    None,
    "",
    " ",
    "The quick brown fox's  tail,\n\n\tjumps; over 12345 lazy dogs.",
    "déjà vu — 漢字 かな 😀😀 naïve\xa0space　wide",
    "<s> text </s> <|endoftext|> <unk> <0x41>",
    "literal ▁ mark",
    "ﬁ ligature and é",
    "\r\n\x00\x1f end\r",
    "word " * 40_000,
    "x" * 30_000,
    "The quick brown fox's  tail,",
    "The quick brown fox's  tail,",
    "   leading and trailing   ",
]


def byte_alphabet():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(texts: list) -> list[tuple]:
    """Plain Python: every occurrence pair by its end, counts by a dictionary."""
    a_tok = tokenizers.Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = byte_alphabet()
    docs = []
    for text in texts:
        text = text or ""
        a_ids, b_ids = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a_ids]
        b_bytes = []
        for i in b_ids:
            p = b_tok.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(([], [], [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, t in enumerate(a_bytes):
            at += len(t)
            ends_a[at] = k
        at = 0
        for k, t in enumerate(b_bytes):
            at += len(t)
            ends_b[at] = k
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ia, jb = ends_a[end], ends_b[end]
            links.append((a_ids[ia], b_ids[jb]))
            groups.append(",".join(map(str, a_ids[i : ia + 1])) + "|" + ",".join(map(str, b_ids[j : jb + 1])))
            i, j = ia + 1, jb + 1
        docs.append((a_ids, b_ids, links, ";".join(groups)))
    count = Counter(p for d in docs for p in d[2])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for a_ids, b_ids, links, groups in docs:
        digest = hashlib.sha256(groups.encode()).hexdigest() if a_ids else ""
        out.append((len(a_ids), len(b_ids), len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


def test_equals_brute_force(spark, documents):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)]).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.statistics(docs, A, B).collect()}
    expected = brute(TEXTS)
    assert [got[i] for i in range(len(TEXTS))] == expected
    assert expected[3][0] and expected[5][0] and not expected[6][0] and not expected[0][0]


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.statistics(docs, A, B).collect()}
    ids = sorted(rows)
    assert [got[i] for i in ids] == brute([rows[i] for i in ids])


def test_memo_may_forget(monkeypatch, spark, documents):
    monkeypatch.setattr(crosstok, "KEPT", 2)
    aligner = crosstok.Aligner(A, B)
    import pyarrow as pa

    rows = list(aligner.rows(pa.array(TEXTS)))
    assert [hashlib.sha256(r[2]).hexdigest() if r[0] else "" for r in rows] == [e[-1] for e in brute(TEXTS)]


def test_groups_as_text(spark, documents):
    docs = documents([(1, "a b", "en", "s"), (2, None, "en", "s")])
    rows = {r.doc_id: r for r in crosstok.aligned(docs, A, B, groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert rows[1].groups.count("|") == rows[1].n_groups == 2 and rows[2].groups == ""


def test_links_have_a_bound_and_empty_table(spark, documents):
    aligner = crosstok.aligner(A, B)
    assert crosstok.most_links(aligner.a, aligner.b) < 1 << 20
    assert crosstok.statistics(documents([]), A, B).count() == 0
