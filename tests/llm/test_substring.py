import numpy as np
import pyarrow as pa

from aridscape.llm import substring
from aridscape.llm.common import components
from aridscape.llm.words import slices

from .conftest import prose


def test_bands():
    assert substring.tuned_bands(0.8, 0.98, 4) == (4, 2)
    b, r = substring.tuned_bands(0.9, 0.99, 6)
    assert 1 - (1 - 0.9**r) ** b >= 0.99


def test_finds_pasted_passages_only(documents):
    passage = prose(99, 60)
    near = passage.split()
    near[30] = "other"
    rows = [(i, prose(i, 150), "en", "a") for i in range(20)]
    for i, text in ((3, passage), (11, passage), (14, " ".join(near))):
        words = rows[i][1].split()
        rows[i] = (i, " ".join(words[:40]) + " " + text + " " + " ".join(words[40:]), "en", "a")
    twice = prose(77, 40)
    rows += [(30, twice + "\n" + twice, "en", "a"), (31, None, None, None), (32, "a b c", "en", "a"), (33, "a b c", "en", "a"), (5, rows[5][1], "en", "a")]
    docs = documents(rows)
    found = substring.repeated(docs).collect()
    assert {r.doc_id for r in found} == {3, 11, 14}
    text = dict((r[0], r[1]) for r in rows)
    first = {}
    for r in found:
        span = text[r.doc_id][r.start : r.stop].split()
        assert sum(w in passage.split() or w == "other" for w in span) >= 0.8 * len(span)
        first.setdefault(r.class_id, []).append((r.doc_id, r.removed))
    assert all([d for d, gone in sorted(x) if not gone] == [min(x)[0]] for x in first.values())
    clean = {r.doc_id: r.text for r in substring.cleaned(docs).collect()}
    assert clean[3] == text[3] and clean[0] == text[0] and len(clean[11]) < len(text[11]) - 150
    assert clean[11].split()[:35] == text[11].split()[:35] and "  " not in clean[11]
    assert substring.cleaned(docs).columns == docs.columns
    assert substring.repeated(documents([])).count() == 0


def test_whole_copies_leave_one(documents):
    rows = [(1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (None, prose(1, 80), "en", "a"), (4, prose(4, 80), "en", "a")]
    clean = {r.doc_id: r.text for r in substring.cleaned(documents(rows)).collect()}
    assert clean[1] == rows[0][1] and clean[4] == rows[3][1]
    assert all(len(clean[i]) < 40 for i in (2, None) if i in clean)


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_layout_of_lines_does_not_matter(documents):
    rows = [(i, prose(i, 90), "en", "a") for i in range(8)]
    for k, seed in enumerate((91, 92, 93)):
        passage = prose(seed, 60)
        layouts = [(wrapped(passage, 4), wrapped(passage, 4)), (wrapped(passage, 4), wrapped(passage, 9)), (wrapped(passage, 1), passage)][k]
        for n, text in enumerate(layouts):
            rows.append((10 + 10 * k + n, prose(200 + 10 * k + n, 40) + "\n" + text + "\n" + prose(300 + 10 * k + n, 40), "en", "a"))
    text = {r[0]: r[1] for r in rows}
    clean = {r.doc_id: r.text for r in substring.cleaned(documents(rows)).collect()}
    for i, t in text.items():
        lost = len(t.split()) - len(clean[i].split())
        assert (30 <= lost <= 60) if i in (11, 21, 31) else lost == 0
        assert clean[i].split()[:40] == t.split()[:40]


def test_cuts_do_not_depend_on_the_row_before():
    def contents(*texts):
        (s,) = slices(pa.array(texts))
        p = substring.Paragraphs(s)
        return p.content[p.row == len(texts) - 1].tolist()

    for seed in range(600):
        text = prose(seed, 40)
        assert contents(text) == contents("before " + prose(1000 + seed, 3), text)


def test_exact_copies_vanish_in_any_order(spark, documents):
    rows = [(i + 200 * c, prose(i, 80), "en", "a") for i in range(60) for c in (0, 1)]
    for order, batch in ((1, "10000"), (-1, "7"), (7, "1")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            mixed = documents(sorted(rows, key=lambda r: r[0] * order % 389)).coalesce(2)
            assert {r.doc_id: r.text for r in substring.cleaned(mixed).collect()} == {r[0]: r[1] for r in rows if r[0] < 200}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def linked(spark, sets, similarity):
    table = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(sets)], "content long, shingles array<long>")
    members = spark.createDataFrame([(1, i) for i in range(len(sets))], "key long, content long")
    found = substring._links(members, table, similarity)
    return found.count(), dict(components(found).collect())


def test_links_of_a_band_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 12, 8)) for _ in range(40)]
    near = [(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    want = dict(components(spark.createDataFrame(near, "u long, v long")).collect())
    for tile in (3, 512):
        monkeypatch.setattr(substring, "TILE", tile)
        assert linked(spark, sets, 0.8)[1] == want


def test_a_frequent_band_is_tiled_and_gives_spanning_links(spark, monkeypatch):
    monkeypatch.setattr(substring, "TILE", 40)
    sets = [[*range(9), 100 + i // 300] for i in range(600)]
    n, roots = linked(spark, sets, 0.95)
    assert roots == {i: i - i % 300 for i in range(600)}
    assert n < 600 * 20  # not the 90,000 pairs


def test_recall_on_pasted_passages(documents):
    """Passages of 60 words in two documents each: nine of ten are found for the better part, and nothing else."""
    rows, planted = [], []
    for k in range(40):
        passage = prose(1000 + k, 60).split()
        for c in (0, 1):
            host = prose(2000 + 2 * k + c, 80).split()
            rows.append((2 * k + c, " ".join([*host[:35], *passage, *host[35:]]), "en", "a"))
        planted.append((2 * k, 2 * k + 1))
    found = substring.repeated(documents(rows)).groupBy("doc_id").agg({"n_words": "sum"}).collect()
    words = {r["doc_id"]: r["sum(n_words)"] for r in found}
    assert sum(words.get(a, 0) > 30 and words.get(b, 0) > 30 for a, b in planted) >= 0.9 * len(planted)
    assert set(words) <= {d for pair in planted for d in pair}


def test_spans_and_blanks():
    assert substring.without_spans("ab cd ef", [(3, 5)]) == "ab ef"
    assert substring.without_spans("ab\ncd\nef", [(3, 5), (0, 2)]) == "\n\nef"
