import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aridscape.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, path int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(convs: dict[int, list[tuple[str, str]]]) -> dict:
    """Every figure of every distinct prefix, from plain sets."""
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, int] = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df) -> list:
    return sorted((tuple(r[c] for c in trie.COLUMNS) for r in df.collect()), key=repr)


def random_rows(seed: int, n: int, words: int, most: int):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            rows.append((c, t, r.choice(["user", "assistant"]), "é" * r.randrange(words) if r.random() < 0.9 else None))
    return rows


def plain(rows):
    convs: dict = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(t)] for c, t in convs.items()}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 10_000])
def test_nodes_equal_sets_over_any_blocks(spark, block):
    rows = random_rows(block, 120, 2, 7) + [(900 + i, t, "user", "same") for i in range(40) for t in range(3)]
    convs = trie.paths(table(spark, rows))
    assert got(trie.nodes(convs, block_sequences=block)) == brute(plain(rows))


def test_heads_of_other_conversations(spark):
    rows = random_rows(5, 90, 3, 14)
    own = plain(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    missing = {c: t for c, t in rebuilt.items() if c >= 5}
    source, turns = F.col("conv_id") - F.pmod("conv_id", F.lit(5)), (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    convs = trie.with_heads(trie.paths(table(spark, rows)), source, turns, most=8)
    assert got(trie.nodes(convs, block_sequences=4)) == brute(rebuilt)
    # conversations 0 to 4 taken away: those that lean on them keep their own tail alone
    late = trie.with_heads(trie.paths(table(spark, [r for r in rows if r[0] % 5])), source, turns, most=8)
    tails = {c: t[zlib.crc32(str(c).encode()) % 9 :] for c, t in own.items() if c % 5}
    assert got(trie.nodes(late, block_sequences=5)) == brute(tails)
    assert missing and any(not t for t in tails.values())


def test_ids_of_many_copies_are_digested_in_order(spark):
    ids = random.Random(1).sample(range(-3000, 9000), 2500)
    rows = [(c, 0, "user", "hi") for c in ids] + [(c, 1, "assistant", "") for c in ids[:1200]]
    assert got(trie.nodes(trie.paths(table(spark, rows)))) == brute(plain(rows))


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "wort " * 300_000
    rows = [(1, None, None, None), (1, 0, "user", long), (2, None, "", ""), (2, 0, "user", long), (2, 0, "user", long), (3, 0, "b", "x"), (3, 0, "a", "y"), (4, 0, "a", "y"), (4, 1, "b", "x")]
    rows += [(5, t, "user", "deep") for t in range(120)]
    expected = brute(plain(rows))
    assert got(trie.nodes(trie.paths(table(spark, [*rows, (None, 0, "user", "lost")])), block_sequences=2)) == expected


def test_empty_table(spark):
    assert trie.nodes(trie.paths(table(spark, []))).count() == 0


def test_extents_equal_a_scan():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        values = r.integers(0, 4, n)
        minima = trie.RangeMin(values)
        at, least = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        for i, d, lo, hi in zip(at, least, minima.left(at, least), minima.right(at, least)):
            a = b = i
            while b + 1 < n and values[b + 1] >= d:
                b += 1
            while a > 0 and values[a] >= d:
                a -= 1
            assert (lo, hi) == (a, b)
