import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aridscape.llm import quality

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


CASES = [None, "", " \n\t", "a\nb\na\n\na ", "a\r\na\r\n", "é漢 #|<>&\n é漢", "x y " * 12, "one two\x1cthree\xa0four", prose(1, 60) + "\n" + prose(1, 60), "w " * 300]


def test_counts_equal_brute_force():
    got = quality.text_statistics(pa.array(CASES))
    for i, text in enumerate(CASES):
        assert [int(got[k][i]) for k in quality.COUNTS] == brute(text), repr(text)


def sample(n=260):
    rows = [(i, prose(i, 60 + i % 90), "en" if i % 3 else None, "a" if i % 2 else "b") for i in range(n)]
    rows += [(900, prose(5, 80).replace(" ", "### $$$ "), "en", "a"), (901, None, None, None), (None, "few words", "en", "a"), (902, "same thing over " * 40, "en", "a")]
    return rows + [rows[0], rows[0]]


def test_rejects_junk_and_keeps_prose(documents):
    docs = documents(sample())
    out = quality.judged(docs, min_rows=50)
    assert out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert not rows[900].kept and not rows[900].base_failed
    assert rows[901].base_failed and rows[None].base_failed and rows[902].base_failed
    assert all(rows[i].kept for i in range(260))
    kept = quality.filtered(docs, min_rows=50)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(260), 0, 0])


def test_a_last_small_pool_is_judged_by_all_rows(documents):
    few = [(1000 + i, prose(400 + i, 60 + i), f"l{i % 3}", "q") for i in range(9)]
    few += [(2000, prose(7, 80).replace(" ", "### $$$ "), "l1", "q")]
    rows = {r.doc_id: r for r in quality.judged(documents(sample() + few), min_rows=50).collect()}
    assert not rows[2000].kept and not rows[2000].base_failed and rows[2000].distance is not None
    assert all(rows[1000 + i].kept for i in range(9)) and all(rows[i].kept for i in range(260))
    assert all(r.kept for r in quality.judged(documents(few[:4])).collect())


def test_limit_nears_the_chi_square_quantile(spark):
    n = spark.createDataFrame([(3,), (10,), (50,), (200,), (10**12,)], "n long")
    got = [r[0] for r in n.select(quality.distance_limit(F.col("n"), 1e-9, 6)).collect()]
    assert got[:2] == [None, None] and got[2] > got[3] > got[4]
    assert abs(got[4] / quality.chi_square_quantile(1 - 1e-9, 6) - 1) < 1e-6
    # the 0.95 quantile of F(6, 20) is 2.599
    t = n.limit(1).select(quality.distance_limit(F.lit(26).cast("long"), 0.05, 6)).first()[0]
    assert abs(t * 26 * 20 / (6 * 25 * 27) - 2.599) < 0.02


def test_estimates_against_brute_force(spark):
    """Concentration steps end in a fixed point that numpy confirms."""
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(0, 1, (900, 6)) * [1, 2, 1, 1, 3, 1], r.normal(14, 0.5, (90, 6))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = quality.covariance_estimates(rows, steps=6).first()
    inverse = np.zeros((6, 6))
    for k, (i, j) in enumerate(quality.PAIRS):
        inverse[i, j] = inverse[j, i] = got["inverse"][k]
    d = np.einsum("ij,jk,ik->i", x - got["centre"], inverse, x - got["centre"])
    near = x[np.argsort(d)[: int(np.ceil(0.75 * len(x)))]]
    assert np.allclose(near.mean(0), got["centre"], atol=0.05)
    assert np.allclose(np.linalg.inv(np.cov(near.T, bias=True) + np.diag(np.square(quality.FLOOR))), inverse, rtol=0.15, atol=0.02)
    limit = quality.chi_square_quantile(0.999, 6)
    assert (d[900:] / got["scale"] > limit).all() and (d[:900] / got["scale"] > limit).mean() < 0.01


def test_empty_table(documents):
    assert quality.judged(documents([])).count() == 0
    assert quality.filtered(documents([])).count() == 0
