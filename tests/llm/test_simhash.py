import numpy as np
import xxhash

from aridscape.llm import simhash
from aridscape.llm.common import components

from .conftest import prose


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids, prints, radius):
    label = dict(zip(range(len(ids)), range(len(ids))))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                for k in label:
                    if label[k] == b:
                        label[k] = a
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, []).append(ids[k])
    return {k: min((x for x in groups[v] if x is not None), default=None) for k, v in label.items()}


def test_groups_equal_brute_force(documents):
    base = prose(1, 200)
    rows = [(10 + i, base.replace("ka", "KA" if i % 2 else "ka") + " tail" * (i % 3), "en", "a") for i in range(12)]
    rows += [(50 + i, prose(i, 5 + 20 * i), "en", "b") for i in range(8)]
    rows += [(3, None, None, None), (2, " \n", "en", "a"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (None, base, "en", "a")]
    got = simhash.near_duplicates(documents(rows)).collect()
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = linked(ids, prints, 2)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in got)) == sorted((i is None, i or 0, signed[k], want[k]) for k, i in enumerate(ids))
    assert simhash.near_duplicates(documents([])).count() == 0


def test_tiles_find_every_link(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 300, dtype=np.uint64)
    flips = centres.copy()
    for k in range(2):
        flips ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
    values = np.unique(np.concatenate([centres, flips]))
    nodes = spark.createDataFrame([(int(v.view(np.int64)), int(v.view(np.int64))) for v in values], "node long, fp long")
    for radius, tile in ((2, 4096), (2, 1), (7, 50), (20, 64)):
        pairs = simhash.tile_pairs(nodes, radius, tile).collect()
        found = set()
        for p in pairs:
            a, b = (np.array([x["fp"] for x in side], np.int64).view(np.uint64) for side in (p["a"], p["b"]))
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            found |= {frozenset((int(a[x]), int(b[y]))) for x, y in zip(i, j) if a[x] != b[y]}
        i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
        assert found == {frozenset((int(values[x]), int(values[y]))) for x, y in zip(i, j) if x != y}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 510), (510, 505), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 505: 500, 510: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(documents):
    base = prose(1, 300).split()
    near = " ".join(base[:150] + ["changed"] + base[151:])
    rows = [(5, " ".join(base), "en", "a"), (6, near, "en", "b"), (7, " ".join(base), "fr", "a"), (8, prose(2, 300), "en", "a"), (9, prose(3, 40), "en", "a")]
    rows += [(5, " ".join(base), "en", "a"), (11, None, None, None), (12, "", "en", "a")]
    kept = simhash.deduplicated(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 9, 11]
    assert kept.columns == documents([]).columns
    assert simhash.deduplicated(documents([])).count() == 0


def test_less_similar_texts_stay(documents):
    def similarity(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
        return len(a & b) / len(a | b)

    rows, gone = [], set()
    for seed in range(12):
        base = prose(seed, 300).split()
        for k, (changes, low, high) in enumerate([(0, 1, 1), (5, 0.83, 0.86), (8, 0.74, 0.78), (14, 0.59, 0.63)]):
            words = list(base)
            for c in range(changes):
                words[20 * c + 5 + k] = f"new{k}x{c}"
            rows.append((10 * seed + k, " ".join(words), "en", "a"))
            assert low <= similarity(rows[-1][1], " ".join(base)) <= high
        gone.add(10 * seed + 1)
    kept = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    assert kept == {r[0] for r in rows} - gone


def test_tiles_of_sets_find_every_link(spark):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 14, 9)) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "node long, shingles array<long>")
    members = spark.createDataFrame([(1, i) for i in range(60)], "key long, node long")
    wanted = dict(components(spark.createDataFrame([p for p in want if p[0] < p[1]], "u long, v long")).collect())
    for tile in (7, 256):
        found = simhash.exact_links(members, table, 0.8, tile)
        assert {(x.u, x.v) for x in found.collect()} <= {(i, j) for i in wanted for j in wanted if wanted[i] == wanted[j]}
        assert dict(components(found).collect()) == wanted
