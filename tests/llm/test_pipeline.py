import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline

from .conftest import prose

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "repeated passages", "mixing", "packing"]
    assert not any(re.search(r"\b(limit|sample)\b", sql, re.I) for name, sql in entry.oracle_sql().items() if name.startswith("op"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op3_mixing", "op7_chat"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, entry.queries()[name](spark, DATA).select(*columns).collect())) == sorted(cursor.fetchall())


def test_stages_do_their_work(spark, documents):
    base = [(i, prose(i, 120 + i % 30), "en", "ab"[i % 2]) for i in range(60)]
    passage = prose(500, 70)
    pasted = [(100 + k, " ".join(prose(600 + k, 40).split()[:30] + passage.split() + prose(700 + k, 40).split()), "en", "a") for k in range(2)]
    rows = base + pasted + [(200, base[3][1], "en", "b"), (201, "too short", "en", "a"), (202, "spam spam spam " * 60, "en", "a"), (203, None, "en", "a")]
    docs = documents(rows).select(*["doc_id", "text", "lang", "source", "n_chars"])
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "stage")
        seen.append((name, docs))
    quality, copies, passages, mixing, packing = (d for _, d in seen)
    assert {r.doc_id for r in quality.collect()} == {r[0] for r in rows} - {201, 202, 203}
    assert {r.doc_id for r in copies.collect()} == {r[0] for r in rows} - {200, 201, 202, 203}
    text = {r.doc_id: r.text for r in passages.collect()}
    assert all(text[i] == t for i, t, _, _ in base) and text[100] == pasted[0][1] and len(text[101]) < len(pasted[1][1]) - 200
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in (quality, copies, passages, mixing))
    copies_of = {}
    for r in mixing.collect():
        copies_of[r.doc_id] = copies_of.get(r.doc_id, 0) + 1
        assert r.text == text[r.doc_id]
    assert max(copies_of.values()) <= 3
    starts = {}
    for p in packing.collect():
        starts[p.doc_id] = starts.get(p.doc_id, 0) + (p.start == 0)
    assert starts == copies_of
