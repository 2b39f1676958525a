"""Filling containers of fixed capacity: large-item matching with best fit for the rest.

The packing is decided on the histogram of sizes, whose length is bounded by the capacity, and
never on the items themselves:

1. an item above the capacity is cut into full pieces and one rest; full pieces are containers;
2. large items (above a third of the capacity) go at most two to a container: from the largest
   down, each takes the largest other large item that still fits beside it;
3. smaller items, from the largest down, go to the tightest gap that holds them; gaps are kept
   in classes of equal width, so a size is settled in as many steps as there are classes, not
   items; what fits no gap opens new containers.

The result is a list of *allotments* (size, ranks of items of that size, containers, items per
container).  Items learn their rank among items of their size from counts per hashed chunk and
a row number within (size, chunk), so that no task holds a whole size, and find their allotment
by binary search in a table bounded by the capacity.

Cases: items of size 0 (null or empty texts) need no container and get none (bin_id null);
copies are items of their own; ties are ordered by hash, then id; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNKS = 256


@dataclass
class Allotment:
    size: int
    rank: int  # first rank of the size
    count: int  # items
    bin: int  # first container
    per: int  # items per container


@dataclass
class Packing:
    allotments: list[Allotment] = field(default_factory=list)
    bins: int = 0
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # gap -> (first container, containers)


def pack_histogram(sizes: dict[int, int], capacity: int) -> Packing:
    """Pack ``sizes`` (size -> count, all within 1..capacity); see the module's text."""
    p, used = Packing(), {}
    left = dict(sizes)

    def take(size: int, count: int, first_bin: int, per: int) -> None:
        p.allotments.append(Allotment(size, used.get(size, 0), count, first_bin, per))
        used[size] = used.get(size, 0) + count
        left[size] -= count

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            p.gaps.setdefault(gap, []).append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        k = bisect.bisect_right(large, capacity - s) - 1
        if k >= 0 and large[k] == s and left[s] < 2:
            k -= 1
        other = large[k] if k >= 0 else None
        if other is None:
            n = left[s]
            take(s, n, p.bins, 1)
            leave(capacity - s, p.bins, n)
        elif other == s:
            n = left[s] // 2
            take(s, 2 * n, p.bins, 2)
            leave(capacity - 2 * s, p.bins, n)
        else:
            n = min(left[s], left[other])
            take(s, n, p.bins, 1)
            take(other, n, p.bins, 1)
            leave(capacity - s - other, p.bins, n)
        p.bins += n
        for x in {s, other} - {None}:  # sizes that are used up are not looked at again
            if not left[x]:
                del large[bisect.bisect_left(large, x)]
    widths = sorted(p.gaps)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(widths, s)
            if k == len(widths):
                per = capacity // s
                n = max(1, left[s] // per)
                per = min(per, left[s])
                first, gap = p.bins, capacity
                p.bins += n
            else:
                gap = widths[k]
                first, n = p.gaps[gap].pop()
                if not p.gaps[gap]:
                    del p.gaps[gap]
                    widths.pop(k)
                per = gap // s
                full = left[s] // per
                keep = n if full >= n else max(full, 1)
                if full == 0:
                    per = left[s]
                if keep < n:
                    if gap not in p.gaps:
                        bisect.insort(widths, gap)
                    leave(gap, first + keep, n - keep)
                n = keep
            take(s, n * per, first, per)
            rest = gap - n * per * s // n
            if rest:
                if rest not in p.gaps:
                    bisect.insort(widths, rest)
                leave(rest, first, n)
    return p


def ranked(items: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (0-based) within ``by``, computed without a task for a whole group."""
    items = items.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(CHUNKS)))
    counts = items.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)))
    within = items.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(*order)))
    return within.join(before.drop("__n"), [*by, "__chunk"]).withColumn("rank", (F.coalesce("__before", F.lit(0)) + F.col("__row") - 1).cast("bigint")).drop("__chunk", "__row", "__before")


def pack_items(items: DataFrame, key: str, size: str, plans: dict[int, tuple[int, str | None]], source: str) -> DataFrame:
    """(plan_id, key, piece_no, token_start, n_tokens, bin_id) of every item of every plan.

    ``plans``: plan -> (capacity, source or None for all).
    """
    # every item is read once and goes to the plans that want it
    known = F.array(*[F.struct(F.lit(p).alias("plan_id"), F.lit(c).cast("bigint").alias("cap"), F.lit(s).cast("string").alias("src")) for p, (c, s) in plans.items()])
    own = items.withColumn("__plan", F.explode(F.filter(known, lambda x: x["src"].isNull() | (x["src"] == F.col(source))))).withColumns({"plan_id": F.col("__plan.plan_id"), "__cap": F.col("__plan.cap")})
    cutting = F.when(F.col(size) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1, F.col("__cap")))
    pieces = own.select("plan_id", F.col(key), F.col(size).alias("__whole"), "__cap", F.posexplode(cutting).alias("piece_no", "token_start"))
    pieces = pieces.withColumn("n_tokens", F.least("__cap", F.col("__whole") - F.col("token_start"))).drop("__whole", "__cap")
    counts: dict[int, dict[int, int]] = {p: {} for p in plans}
    for r in pieces.where("n_tokens > 0").groupBy("plan_id", "n_tokens").count().collect():  # bounded by the sum of capacities
        counts[r["plan_id"]][r["n_tokens"]] = r["count"]
    tables = {}
    for plan, (capacity, _) in plans.items():
        rows = sorted(((a.size, a.rank, a.bin, a.per) for a in pack_histogram(counts[plan], capacity).allotments))
        code = np.array([s for s, *_ in rows], np.int64), np.array([r for _, r, *_ in rows], np.int64)
        tables[plan] = (code[0], code[1], np.array([b for *_, b, _ in rows], np.int64), np.array([k for *_, k in rows], np.int64))
    placed = ranked(pieces, ["plan_id", "n_tokens"], [key, "piece_no"])
    ddl = f"plan_id int, `{key}` {items.schema[key].dataType.simpleString()}, piece_no int, token_start bigint, n_tokens bigint, bin_id bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plan, n, rank = (np.asarray(b.column(i)) for i in (0, 4, 5))
            out = np.full(b.num_rows, -1, np.int64)
            for p, (size_, first, bin_, per) in tables.items():
                at = np.flatnonzero((plan == p) & (n > 0))
                if len(at):
                    lo, hi = np.searchsorted(size_, n[at], "left"), np.searchsorted(size_, n[at], "right")
                    # allotments of a size are sorted by rank: search all at once on a combined code
                    base = int(rank.max()) + 2 if len(rank) else 1
                    base = max(base, int(first.max()) + 2)
                    k = np.searchsorted(size_ * base + first, n[at] * base + rank[at], "right") - 1
                    k = np.clip(k, lo, hi - 1)
                    out[at] = bin_[k] + (rank[at] - first[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, mask=out < 0)], names=["plan_id", key, "piece_no", "token_start", "n_tokens", "bin_id"])

    return placed.select("plan_id", key, "piece_no", "token_start", "n_tokens", "rank").mapInArrow(run, ddl)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers and fill of every plan; ``lower_bound`` is the least number any packing needs by volume."""
    bins = packed.where(F.col("bin_id").isNotNull()).groupBy("plan_id", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    per = bins.groupBy("plan_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("pieces").alias("pieces"))
    out = capacities.select("plan_id", "capacity_tokens").join(per, "plan_id", "left")
    return out.withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).withColumn("lower_bound", F.ceil(F.col("tokens") / F.col("capacity_tokens")))


def sized(df: DataFrame, key: str, source: str, text: str, **tokenizer) -> DataFrame:
    """(key, source, n_tokens) of all texts, written once: encoding is the dear part."""
    from .tokens import with_tokens

    return cut(with_tokens(df, [key, source], text, **tokenizer))
