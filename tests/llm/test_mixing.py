import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from aridscape.llm import mixing

from .conftest import prose


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 100, "c": 90}, {"a": 3, "b": 1, "c": 1})
    assert got == {"a": 30.0, "b": 85.0, "c": 85.0}
    assert mixing.targets({"a": 0}, {"a": 1}) == {"a": 0.0} and mixing.targets({}, {}) == {}


def cheapest(capacity, quota, members, copies=3):
    """Best (flow, -cost) by trying all flows of tiny problems."""
    arcs = [(p, s) for p in capacity for s in members[p]]
    best = (0, 0)
    for f in itertools.product(*[range(quota[s] + 1) for _, s in arcs]):
        out = {p: sum(x for (q, _), x in zip(arcs, f) if q == p) for p in capacity}
        into = {s: sum(x for (_, t), x in zip(arcs, f) if t == s) for s in quota}
        if all(into[s] <= quota[s] for s in quota) and all(out[p] <= copies * capacity[p] for p in capacity):
            cost = sum(max(0, min(out[p] - k * capacity[p], capacity[p])) * k for p in capacity for k in range(copies))
            best = max(best, (sum(f), -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_largest_and_cheapest(seed):
    r = random.Random(seed)
    capacity = {p: r.randrange(1, 4) for p in "xyz"}
    quota = {s: r.randrange(0, 6) for s in "ab"}
    members = {p: r.sample("ab", r.randrange(1, 3)) for p in "xyz"}
    flow = mixing.min_cost_flow(capacity, quota, members)
    out = {p: sum(v for (q, _), v in flow.items() if q == p) for p in capacity}
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= quota[s] for s in quota)
    cost = sum(max(0, min(out[p] - k * capacity[p], capacity[p])) * k for p in capacity for k in range(3))
    assert (sum(flow.values()), -cost) == cheapest(capacity, quota, members)


def brute(rows, seed=17):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, _, s in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    out = []
    for s in sizes:
        quota, at = int(goal[s] + 0.5), 0
        for i, _, n, key in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] or 0, d[2])):
            whole = (quota - 1) // sizes[s] if quota and sizes[s] else 0
            more = 2 * at + n <= 2 * (quota - whole * sizes[s])
            out.append((i, n, sizes[s], round(goal[s], 6), n * (whole + more)))
            at += n
    return out


def table(n=120):
    rows = [(i, prose(i, 3 + (i * 7) % 50), "en", ["a", "b", "c", None, "é"][(i * i) % 5]) for i in range(n)]
    return rows + [(n, None, "en", "b"), (n + 1, prose(9, 4000), "en", "c"), (None, "x y", "en", "Z")]


def test_taken_equals_brute_force(documents):
    rows = table()
    got = mixing.taken(documents(rows), bucket_rows=8).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    again = mixing.taken(documents(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again), key=key) == sorted(map(tuple, got), key=key)


def test_mixed_repeats_rows(documents):
    docs = documents(table())
    want = {r.doc_id: r.taken // r.size for r in mixing.taken(docs).collect() if r.taken}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_overlapping_sources_fill_their_quotas(documents):
    rows = [(i, prose(i, 20), "en", "a") for i in range(300)]
    docs = documents(rows).withColumn("sets", F.expr("CASE WHEN doc_id % 3 = 0 THEN array('u') WHEN doc_id % 3 = 1 THEN array('u', 'v') ELSE array('v') END"))
    sizes, cuts, totals = mixing.decisions(docs, memberships=F.col("sets"), weights={"u": 1, "v": 3})
    both = sizes.join(cuts, F.col("pattern") == F.col("cut_pattern"))
    given = both.select("size", F.explode(mixing.given(F.col("key"), F.col("cuts"))).alias("to")).groupBy("to.source").agg(F.sum("size").alias("n"))
    got = {r["source"]: r["n"] for r in given.collect()}
    assert all(abs(got[s] - totals["target"][s]) <= 40 for s in "uv")


def test_empty_tables(documents):
    assert mixing.taken(documents([])).count() == 0 and mixing.mixed(documents([])).count() == 0
    assert mixing.mixed(documents([(1, None, "en", "a"), (2, " ", "en", None)])).count() == 0
    with pytest.raises(ValueError):
        mixing.taken(documents(table()), max_patterns=2)
