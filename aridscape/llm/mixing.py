"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources they count
for). A flow carries token capacity from the patterns to the sources' quotas;
using a pattern once is free, and every further repetition costs more, so that
documents repeat only where a quota needs it. Seeded documents are then chosen
inside each pattern: its documents, in the order of a seeded hash and once per
repetition, form a line of tokens that the flow cuts into pieces, one per source.
A document's copies follow from its hash and its pattern's cuts alone.

Only the table of patterns (sizes, no documents) reaches the driver; more than
``max_patterns`` patterns raise an error instead of being dropped.

Defined results: null text has size 0; a null source is a source of its own, in
order after all others; a null or empty membership list is the pattern of that
source; equal rows share one fate; ties in the hash are broken by ``doc_id`` and
size; an empty table gives no rows; other columns, whatever their names, are kept
by ``mixed`` and left out by ``decisions``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aridscape.llm.common import boxed, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3


def size_column(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_column(doc_id: Column, text: Column, seed: int) -> Column:
    """Seeded place of a document in its pattern, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def targets(sizes: dict, weights: dict, limit: int = MAX_COPIES) -> dict:
    """Shares of the total size by weight, none above ``limit`` times its source:
    the excess is shared again by weight until none is above."""
    rest, out = float(sum(sizes.values())), {}
    open_weight = float(sum(weights[s] for s in sizes))
    for s in sorted(sizes, key=lambda s: limit * sizes[s] / weights[s]):
        fair = rest / open_weight * weights[s] if open_weight > 0 else 0.0
        out[s] = min(fair, float(limit * sizes[s]))
        rest -= out[s]
        open_weight -= weights[s]
    return out


def min_cost_flow(capacity: dict, quota: dict, members: dict, max_copies: int = MAX_COPIES) -> dict:
    """Tokens from each pattern to each source: the largest flow, at least cost.

    The k-th repetition of a token costs k - 1, so the cost of a pattern is
    convex. Shortest augmenting paths with potentials; a path is filled to its
    bottleneck.
    """
    nodes = {"in": 0, "out": 1}
    graph: list[list[list]] = [[], []]  # edges: [to, free, cost, place of the reverse edge]

    def node(name):
        if name not in nodes:
            nodes[name] = len(graph)
            graph.append([])
        return nodes[name]

    def edge(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    used = {}
    for p in capacity:
        for k in range(max_copies):
            edge(0, node(("p", p)), capacity[p], k)
        for s in members[p]:
            used[p, s] = edge(node(("p", p)), node(("s", s)), max_copies * capacity[p], 0)
    for s, q in quota.items():
        edge(node(("s", s)), 1, q, 0)
    potential = [0] * len(graph)
    while True:
        distance = [None] * len(graph)
        came: list = [None] * len(graph)
        distance[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                new = d + cost + potential[a] - potential[b]
                if room > 0 and (distance[b] is None or new < distance[b]):
                    distance[b], came[b] = new, (a, i)
                    heapq.heappush(queue, (new, b))
        if distance[1] is None:
            break
        highest = max(d for d in distance if d is not None)
        potential = [x + (highest if d is None else d) for x, d in zip(potential, distance)]
        path, b = [], 1
        while b:
            a, i = came[b]
            path.append(graph[a][i])
            b = a
        step = min(e[1] for e in path)
        for e in path:
            e[1] -= step
            graph[e[0]][e[3]][1] += step
    return {k: max_copies * capacity[k[0]] - e[1] for k, e in used.items()}


def _pattern_id(memberships: Column) -> Column:
    """Text that names a set of sources: sorted, each quoted, null last."""
    known = F.array_sort(F.array_distinct(F.filter(memberships, lambda x: x.isNotNull())))
    nulls = F.exists(memberships, lambda x: x.isNull()) | (F.size(memberships) <= 0) | memberships.isNull()
    return F.to_json(F.struct(known.alias("sources"), F.coalesce(nulls, F.lit(True)).alias("none")))


def _sources(pattern: str) -> list:
    import json

    parsed = json.loads(pattern)
    return parsed.get("sources", []) + ([None] if parsed["none"] else [])


def cycle_weights(sources: list, cycle: tuple = (1, 2, 3)) -> dict:
    """Weights by code point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode())
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered + [None] * (None in sources))}


def decisions(
    docs: DataFrame, memberships: Column | None = None, weights: dict | None = None, seed: int = 17, max_patterns: int = 100_000, bucket_rows: int = 4096
) -> tuple[DataFrame, DataFrame, dict]:
    """Rows ``doc_id, pattern, key, size``, cuts per pattern, and targets per source.

    ``memberships`` is the array of a row's sources (its ``source`` by default);
    ``weights`` maps sources to weights (1, 2, 3 repeating by default). Cuts
    (``cut_pattern, cuts``) are an array of ``level, key, source``: a document's
    copy number ``level`` (from 0) goes to the source of the first cut beyond its
    place, and is not taken behind the last one.
    """
    spark = docs.sparkSession
    memberships = F.array(F.col("source")) if memberships is None else memberships
    rows = written(
        docs.select("doc_id", _pattern_id(memberships).alias("pattern"), key_column(F.col("doc_id"), F.col("text"), seed).alias("key"), size_column(F.col("text")).alias("size")),
        "sizes",
    )
    summary = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(summary) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {r["pattern"]: r["size"] for r in summary}
    members = {p: _sources(p) for p in capacity}
    sizes: dict = {}
    for p, c in capacity.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + c
    wanted = targets(sizes, weights or cycle_weights(list(sizes)))
    flow = min_cost_flow(capacity, {s: int(t + 0.5) for s, t in wanted.items()}, members)

    lines = []
    for p, c in capacity.items():
        at = 0
        for s in members[p]:
            if flow[p, s] > 0:
                at += flow[p, s]
                level = (at - 1) // c
                lines.append((p, level, at - level * c, s, at, max(1, -(-[r["n"] for r in summary if r["pattern"] == p][0] // bucket_rows))))
    ends = spark.createDataFrame(lines, "pattern string, level int, upto long, source string, at long, buckets long")

    # the first document whose middle lies behind a cut, found bucket by bucket of the hash
    buckets = ends.select("pattern", "buckets").distinct()
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32))
    placed = rows.where("size > 0").join(buckets, "pattern").withColumn("bucket", place)
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"))
    sums = sums.withColumn("before", F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size"))
    hit = ends.join(sums, "pattern").where("upto > before AND upto <= before + size").select("pattern", "bucket", "before", "level", "upto", "source", "at")
    hit = written(hit, "cuts")
    inside = placed.join(hit.select("pattern", "bucket", "before").distinct(), ["pattern", "bucket"])
    order = Window.partitionBy("pattern", "bucket").orderBy("key", "doc_id", "size")
    inside = inside.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    behind = hit.join(inside.select("pattern", "bucket", "key", "start", F.col("size").alias("own")), ["pattern", "bucket"])
    behind = behind.where("2 * start + own > 2 * upto").groupBy("pattern", "at").agg(F.min("key").alias("key"))
    # no such document in the bucket: the cut lies at the bucket's upper end
    edge = F.lpad(F.lower(F.hex(F.ceil((F.col("bucket") + 1) * F.lit(1 << 32) / F.col("buckets")).cast("long"))), 8, "0")
    cuts = hit.join(behind, ["pattern", "at"], "left").join(buckets, "pattern")
    upper = F.when(F.col("bucket") + 1 >= F.col("buckets"), F.lit("g")).otherwise(edge)
    cuts = cuts.select("pattern", F.struct("at", "level", F.coalesce("key", upper).alias("key"), "source").alias("cut"))
    cuts = cuts.groupBy(F.col("pattern").alias("cut_pattern")).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    return rows, written(cuts, "cuts"), {"size": sizes, "target": wanted}


def given(key: Column, cuts: Column, max_copies: int = MAX_COPIES) -> Column:
    """Array of the sources that a document's copies go to (a struct each)."""

    def of(level):
        ahead = F.filter(cuts, lambda c: (c["level"] > level) | ((c["level"] == level) & (key < c["key"])))
        return F.try_element_at(ahead, F.lit(1))

    all_levels = F.array(*[of(k) for k in range(max_copies)])
    return F.filter(F.coalesce(all_levels, F.array()), lambda c: c.isNotNull())


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with its columns."""
    memberships = options.get("memberships")
    _, cuts, _ = decisions(docs, seed=seed, **options)
    pattern = _pattern_id(F.array(F.col("source")) if memberships is None else memberships)
    rows = boxed(docs, pattern=pattern, key=key_column(F.col("doc_id"), F.col("text"), seed), empty=size_column(F.col("text")) == 0)
    rows = rows.join(cuts, F.col("pattern") == F.col("cut_pattern"))
    copies = F.when(F.col("empty"), 0).otherwise(F.size(given(F.col("key"), F.col("cuts"))))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def taken(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for documents of one source each."""
    rows, cuts, totals = decisions(docs, seed=seed, **options)
    spark = docs.sparkSession
    of_source = spark.createDataFrame(
        [(s, totals["size"][s], totals["target"][s]) for s in totals["size"]], "source string, source_size long, target double"
    ).select(_pattern_id(F.array("source")).alias("pattern"), "source_size", "target")
    out = rows.join(of_source, "pattern").join(cuts, F.col("pattern") == F.col("cut_pattern"), "left")
    copies = F.greatest(F.size(given(F.col("key"), F.col("cuts"))), F.lit(0))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies).alias("taken"))
