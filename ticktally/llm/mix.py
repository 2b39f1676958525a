"""Mixing sources to target weights: min-cost flow over membership patterns.

Documents are aggregated by *pattern*, the set of sources they belong to (one source each in
plain data, several where sources overlap), into tokens per pattern.  A small network routes
capacity from patterns to the quotas of sources:

    start -> (pattern, pass r) -> source -> end

Pass r of a pattern can carry the pattern's tokens once; its cost r is convex in the number of
repetitions, so that every document is used once before any is used twice.  A source may draw
on passes up to its own limit of repetitions, so a document is never given to it more often.  The network's size is the number
of patterns times passes, not that of documents.

Each (pattern, pass) is then a line of documents in seeded order, of which the sources take
consecutive stretches.  A document belongs to the stretch its middle lies in, so stretches take
whole documents and miss each end by half a document at most, on either side.  Starts are prefix
sums over hashed buckets and within them, so no task sums up a whole pattern.  Passes beyond what
the quotas of a pattern's sources could use are not planned.

A quota that can't be filled (no documents, or too few at the limit of repetitions) is filled as far
as it goes and the report says so.  The quotas of other sources stay as they are.

Cases: weights are scaled by their sum; a weight of 0 selects nothing; a source without
documents is in the report with 0; documents without a source, null or in another spelling,
belong to no source but count in the total that budgets refer to; empty texts have no tokens
and are never selected; empty tables give an empty selection.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost) of a maximum flow of least cost; successive shortest paths."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    while True:
        far, via, inside = [None] * n, [-1] * n, [False] * n
        far[start] = 0
        line = deque([start])
        while line:
            x = line.popleft()
            inside[x] = False
            for e in head[x]:
                if cap[e] > 0 and (far[to[e]] is None or far[x] + cost[e] < far[to[e]]):
                    far[to[e]], via[to[e]] = far[x] + cost[e], e
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        line.append(to[e])
        if far[end] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        push, x = None, end
        while x != start:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = end
        while x != start:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def route(patterns: dict[tuple[str, ...], int], targets: list[Target], budget: int) -> tuple[dict[str, int], list[tuple[tuple[str, ...], int, str, int, int]]]:
    """Quotas, and the stretches (pattern, pass, source, from, to) in tokens along a pattern's line."""
    total = sum(t.weight for t in targets if t.weight > 0)
    quota = {t.source: int(round(budget * t.weight / total)) if total and t.weight > 0 else 0 for t in targets}
    useful = {p: -(-sum(quota[t.source] for t in targets if t.source in p) // max(1, patterns[p])) for p in patterns}
    tiers = [(p, r) for p in patterns for r in range(1, min(max((t.max_repeats for t in targets if t.source in p), default=0), useful[p]) + 1)]
    node = {x: i + 1 for i, x in enumerate(tiers)}
    source = {t.source: len(tiers) + 1 + i for i, t in enumerate(targets)}
    end = len(tiers) + len(targets) + 1
    arcs, named = [(0, node[x], patterns[x[0]], x[1]) for x in tiers], {}
    for x in tiers:
        for t in targets:
            if t.source in x[0] and x[1] <= t.max_repeats:
                named[len(arcs)] = (x, t.source)
                arcs.append((node[x], source[t.source], patterns[x[0]], 0))
    arcs += [(source[t.source], end, quota[t.source], 0) for t in targets]
    flow = min_cost_flow(end + 1, arcs, 0, end)
    out, at = [], {}
    for i, (x, s) in sorted(named.items()):
        if flow[i]:
            out.append((x[0], x[1], s, at.get(x, 0), at.get(x, 0) + flow[i]))
            at[x] = at.get(x, 0) + flow[i]
    return quota, out


def lines(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``start``: tokens before a document in the seeded order of its pattern."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**40)).alias("h")
    d = docs.withColumn("__h", h).withColumn("__b", (F.col("__h") / (2**40 / BUCKETS)).cast("int"))
    sums = d.groupBy("pattern", "__b").agg(F.sum("n_tokens").alias("__s"))
    sums = sums.withColumn("__before", F.sum("__s").over(Window.partitionBy("pattern").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern", "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__inner", inner).join(sums.drop("__s"), ["pattern", "__b"])
    return d.withColumn("start", F.coalesce("__before", F.lit(0)) + F.coalesce("__inner", F.lit(0))).drop("__h", "__b", "__inner", "__before")


BROADCAST = 100_000  # stretches; with more of them the join is an ordinary one


def select(docs: DataFrame, key: str, stretches: list[tuple[int, tuple[str, ...], int, str, int, int]], seed: int) -> DataFrame:
    """(mix_id, key, source, n_tokens, repeats); ``docs``: key, pattern (sorted array), n_tokens.

    The stretches that a mix and source have in a pattern are one row, in which a document's passes are counted."""
    by: dict[tuple, list] = {}
    for m, p, _, s, a, b in stretches:
        by.setdefault((m, p, s), []).append((a, b))
    rows = [(m, list(p), s, x) for (m, p, s), x in by.items()]
    plan = docs.sparkSession.createDataFrame(rows, "mix_id int, pattern array<string>, source string, stretches array<struct<lo: bigint, hi: bigint>>")
    placed = lines(docs.where("n_tokens > 0"), key, seed).withColumn("__mid", F.col("start") + F.floor(F.col("n_tokens") / 2))
    hit = placed.join(F.broadcast(plan) if len(stretches) <= BROADCAST else plan, "pattern")
    repeats = F.size(F.filter("stretches", lambda x: (x["lo"] <= F.col("__mid")) & (F.col("__mid") < x["hi"])))
    return hit.select("mix_id", key, "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")
