import collections
import math

import numpy as np
import pytest

from aridscape.llm import katz

from .conftest import prose


def brute(rows, order):
    """Scores by recursion over dictionaries, and the sums of some conditional distributions."""
    docs = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [katz.in_training(i) for i, _ in rows]
    grams = [collections.Counter() for _ in range(order + 1)]
    after = [collections.defaultdict(set) for _ in range(order + 1)]
    total = [collections.Counter() for _ in range(order + 1)]

    def history(t, i, n):
        return tuple(t[j] if j >= 0 else "<s>" for j in range(i - n + 1, i))

    for t in (d for d, use in zip(docs, train) if use):
        for i in range(len(t)):
            for n in range(1, order + 1):
                h = history(t, i, n)
                grams[n][h, t[i]] += 1
                after[n][h].add(t[i])
                total[n][h] += 1
    discounts = [None]
    for n in range(1, order + 1):
        of = collections.Counter(grams[n].values())
        discounts.append(katz.good_turing([of[r] for r in range(1, katz.TOP + 2)]))

    def kept(n, c):
        return c * discounts[n][c - 1] if 0 < c <= katz.TOP else c

    known = [w for _, w in grams[1]]
    size = sum(grams[1].values())
    held = sum(kept(1, c) for c in grams[1].values())
    divisor = size if size - held > 1e-9 * size else size + 1
    unknown = 1 - held / divisor if size else 1.0
    weights = {}

    def weight(n, h):
        if (n, h) not in weights:
            if not total[n][h]:
                weights[n, h] = (1.0, 1)
            else:
                mass = sum(kept(n, grams[n][h, w]) for w in after[n][h])
                by = total[n][h] if total[n][h] - mass > 1e-9 * total[n][h] else total[n][h] + 1
                weights[n, h] = ((1 - mass / by) / (1 - sum(p(n - 1, h[1:], w) for w in after[n][h])), by)
        return weights[n, h]

    def p(n, h, w):
        c = grams[n][h, w]
        if n == 1:
            return kept(1, c) / divisor if c else unknown
        a, by = weight(n, h)
        return kept(n, c) / by if c else a * p(n - 1, h[1:], w)

    for h in list(total[order])[:4] + [("never",) * (order - 1)]:
        assert sum(p(order, h, w) for w in known) + p(order, h, "unseen") == pytest.approx(1, abs=1e-9)
    out = []
    for (i, _), t, use in zip(rows, docs, train):
        seen = [grams[1][(), w] for w in t]
        base = sum(math.log10((c + 0.1) / (size + 0.1 * (len(known) + 1))) for c in seen)
        score = sum(math.log10(p(order, history(t, k, order), t[k])) for k in range(len(t)))
        out.append((i, not use, len(t), sum(c > 0 for c in seen), size, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


ROWS = [(i, prose(i % 40, 5 + i % 60)) for i in range(90)] + [(200, None), (201, " \n"), (None, "ka la"), (7, prose(7, 12)), (7, prose(7, 12)), (300, "the " * 500), (301, "THE <s> é")]


@pytest.mark.parametrize("order, chunk, hot", [(1, 400, 50), (2, 400, 50), (3, 300, 20), (2, 10**6, 10**6)])
def test_scores_equal_recursion(spark, order, chunk, hot):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, chunk int, vocabulary string").repartition(3)
    same(katz.score(docs, order=order, chunk=chunk, hot=hot).collect(), brute(ROWS, order))


def test_better_than_the_base_on_held_out_text(spark):
    docs = spark.createDataFrame([(i, prose(i % 30, 80)) for i in range(200)], "doc_id long, text string")
    held = [r for r in katz.score(docs).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_registered_model_holds_trigrams(spark, tmp_path):
    from aridscape.llm.queries import QUERIES

    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op1_katz"](spark, str(tmp_path)).collect(), brute(ROWS, 3))


def test_no_training_and_no_rows(spark):
    schema = "doc_id long, text string"
    held = [i for i in range(60) if not katz.in_training(i)][:2]
    out = katz.score(spark.createDataFrame([(i, "a b") for i in held], schema)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in out] == [(True, 3, 0, 0, 0.0)] * 2
    assert katz.score(spark.createDataFrame([], schema)).count() == 0


def test_discounts():
    assert all(0 < d < 1 for d in katz.good_turing([1000, 400, 200, 120, 80, 55]))
    assert all(0 < d <= 1 for d in katz.good_turing([0, 0, 0, 0, 0, 0])) and all(0 < d < 1 for d in katz.good_turing([3, 0, 1, 0, 0, 9]))


@pytest.mark.parametrize("order, hot", [(2, 10), (3, 10), (4, 10**6)])
def test_scores_over_many_partitions_and_spread_contexts(spark, order, hot):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    same(katz.score(docs, order=order, chunk=300, hot=hot, entries=300).collect(), brute(ROWS, order))


def test_kept_tables_hold_all_ngrams(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    katz.score(docs, order=3, chunk=300, hot=20, entries=300, path=f"file://{tmp_path}/m").collect()
    known = {0}  # identities of the level below
    want = [collections.Counter() for _ in range(4)]
    for i, t in ROWS:
        words = (t or "").encode().lower().split() + [None]
        for n in (2, 3):
            for k in range(len(words) if katz.in_training(i) else 0):
                want[n][tuple(words[j] if j >= 0 else "<s>" for j in range(k - n + 1, k + 1))] += 1
    for n in (2, 3):
        got, own = [], []
        for row in spark.read.schema(katz.RESULT).parquet(f"file://{tmp_path}/m/level={n}").where("kind = 'model'").collect():
            context, words = katz._stepped(row.parts[0]), katz.unpacked(row.parts[2])
            got += katz.unpacked(row.parts[3]).tolist()
            numbers = katz._stepped(row.parts[4]) + (row.bucket << katz.NUMBER)
            own += numbers.tolist()
            assert n == 2 or known.issuperset(context.tolist())
            assert len(words) == len(numbers) == katz.unpacked(row.parts[1]).sum()
        assert len(set(own)) == len(own)
        known |= set(own)
        assert sorted(got) == sorted(want[n].values())


def test_requests_take_few_bytes():
    """A trigram asked for took 6.6 bytes here while contexts went as hashes and lower levels as doubles."""
    rng = np.random.default_rng(5)
    n = 200_000
    words = rng.zipf(1.3, n) % 20_000
    vocabulary, tokens = np.unique(words, return_inverse=True)
    counts = np.bincount(tokens)
    number = np.empty(len(counts), np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1)
    row = {"lengths": katz.packed(np.full(n // 100, 100)), "train": katz.packed(np.ones(n // 100, np.uint8)), "ranks": katz.packed(np.arange(len(counts))), "tokens": katz.packed(tokens)}
    discounts = katz.good_turing(katz._counts_of_counts(counts))
    levels = {1: (n, len(counts), discounts, float(n), 0.1)}
    chunk = katz.Chunk(row, {1: [(0, [katz.packed(number), katz.packed(counts)])]}, levels, n // 100, 0)
    for level in (2, 3):
        chunk.requests(10**6)
        asks = chunk.asked(7)
        table = katz._merge_grams(level == 3, False)(katz._table(asks))
        chunk.answered([(0, p) for k, p in zip(table.column("kind").to_pylist(), table.column("parts").to_pylist()) if k == "answer"], discounts)
    assert sum(len(p) for a in asks for p in a[4]) < 3 * len(chunk.counts)
