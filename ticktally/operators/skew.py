"""Fragment-replicate by estimated load: per-key work without straggler tasks.

The plan is made from row counts per key.  Keys above a fraction of a task's fair share
are *heavy*: each gets as many shards as its load needs.  All other keys fall into hashed
bins.  Shards and bins are packed onto tasks, largest first, always onto the least loaded
task.  A row of a heavy key picks its shard by the hash of a salt column, so equal salts
meet in one task; the matching side of a join is replicated only to the shards of heavy
keys and is not replicated for the others.

What the plan holds is bounded by the number of tasks, never by the data: at most
``tasks / heavy_share`` heavy keys and ``bins_per_task * tasks`` bins.  That is also the
bound of everything that is broadcast.

Cases: null keys form a key of their own in aggregates and never match in joins; empty
input gives an empty result; repeated rows are counted unless ``distinct_by`` is used;
columns beside the named ones, whatever they are called, are carried or dropped untouched.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallelism

_BIN, _TASK, _HEAVY = "__fr_bin", "__fr_task", "__fr_heavy"
TASK_ROWS = 4_000_000  # of a planned task; more rows make more tasks


@dataclass(frozen=True)
class FragmentPlan:
    keys: tuple[str, ...]
    tasks: int
    bins: tuple[int, ...]  # bin -> task
    heavy: tuple[tuple[tuple, tuple[int, ...]], ...]  # key values -> task of each shard
    loads: tuple[int, ...]  # planned rows of each task


def _bin(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def pack(pieces: list[tuple[int, object]], tasks: int) -> tuple[dict, list[int]]:
    """Largest-first packing of (load, name) onto ``tasks``; returns name -> task and the loads."""
    heap = [(0, t) for t in range(tasks)]
    place: dict = {}
    loads = [0] * tasks
    for load, name in sorted(pieces, key=lambda x: (-x[0], str(x[1]))):
        now, t = heapq.heappop(heap)
        place[name] = t
        loads[t] = now + load
        heapq.heappush(heap, (loads[t], t))
    return place, loads


def plan_fragments(df: DataFrame, keys: Sequence[str], tasks: int | None = None, heavy_share: float = 0.25, bins_per_task: int = 8) -> FragmentPlan:
    """Measure the load of every key over all rows and pack it onto tasks.

    One job with map-side combine reads the key columns; what reaches the driver is one row
    per bin, with the heavy keys in it.
    """
    total = df.count()
    tasks = tasks or max(parallelism(df.sparkSession), -(-total // TASK_ROWS))
    nbins = bins_per_task * tasks
    fair = max(1.0, total / tasks)
    least = max(1, int(fair * heavy_share))
    loads = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn(_BIN, _bin(keys, nbins))
    is_heavy = F.col("n") > least
    rows = (
        loads.groupBy(_BIN)
        .agg(
            F.sum(F.when(~is_heavy, F.col("n")).otherwise(0)).alias("light"),
            F.collect_list(F.when(is_heavy, F.struct(F.col("n").alias("n"), F.struct(*keys).alias("k")))).alias("heavy"),
        )
        .collect()
    )
    pieces: list[tuple[int, object]] = []
    shards: dict[tuple, int] = {}
    light = {r[_BIN]: int(r["light"]) for r in rows}
    for b in range(nbins):
        pieces.append((light.get(b, 0), ("bin", b)))
    for r in rows:
        for h in r["heavy"]:
            key = tuple(h["k"])
            shards[key] = n = max(1, -(-int(h["n"]) // least))
            pieces += [(-(-int(h["n"]) // n), ("key", key, i)) for i in range(n)]
    place, got = pack(pieces, tasks)
    return FragmentPlan(
        tuple(keys), tasks, tuple(place[("bin", b)] for b in range(nbins)),
        tuple((k, tuple(place[("key", k, i)] for i in range(n))) for k, n in sorted(shards.items(), key=str)), tuple(got),
    )


def _plan_tables(df: DataFrame, plan: FragmentPlan) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    bins = spark.createDataFrame([(b, t) for b, t in enumerate(plan.bins)], f"{_BIN} int, __fr_bt int")
    fields = [T.StructField(f"__fr_k{i}", df.schema[k].dataType) for i, k in enumerate(plan.keys)]
    heavy = spark.createDataFrame([(*k, list(ts)) for k, ts in plan.heavy], T.StructType([*fields, T.StructField(_HEAVY, T.ArrayType(T.IntegerType()))]))
    return bins, heavy


def _marked(df: DataFrame, plan: FragmentPlan) -> DataFrame:
    """Add the bin's task and, for heavy keys, the list of the shards' tasks (both sides small and bounded)."""
    bins, heavy = _plan_tables(df, plan)
    df = df.withColumn(_BIN, _bin(plan.keys, len(plan.bins)))
    df = df.join(F.broadcast(bins), _BIN)
    if plan.heavy:
        on = [df[k].eqNullSafe(heavy[f"__fr_k{i}"]) for i, k in enumerate(plan.keys)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        df = df.join(F.broadcast(heavy), cond, "left").drop(*[f"__fr_k{i}" for i in range(len(plan.keys))])
    else:
        df = df.withColumn(_HEAVY, F.lit(None).cast("array<int>"))
    return df


def place(df: DataFrame, plan: FragmentPlan, salt: Sequence[str]) -> DataFrame:
    """Move every row to the task the plan gives it; adds ``__fr_task``."""
    df = _marked(df, plan)
    shard = F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.size(_HEAVY))
    df = df.withColumn(_TASK, F.when(F.col(_HEAVY).isNull(), F.col("__fr_bt")).otherwise(F.get(F.col(_HEAVY), shard.cast("int"))))
    return df.drop(_BIN, "__fr_bt", _HEAVY).repartitionById(plan.tasks, F.col(_TASK))


def fragment_aggregate(df: DataFrame, keys: Sequence[str], salt: Sequence[str], partial: list[Column], final: list[Column], plan: FragmentPlan | None = None) -> DataFrame:
    """Per-key aggregate: shards aggregate on their own, the few shard rows of a key are then combined.

    ``partial`` are aggregates over rows, ``final`` aggregates over the shard rows.
    """
    plan = plan or plan_fragments(df, keys)
    placed = place(df, plan, salt)
    per_shard = placed.groupBy(_TASK, *keys).agg(*partial)
    return per_shard.groupBy(*keys).agg(*final)


def fragment_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salt: Sequence[str], how: str = "inner", plan: FragmentPlan | None = None) -> DataFrame:
    """Equi-join on ``keys``: ``big`` is fragmented, ``small`` replicated to the shards of heavy keys only.

    ``how`` is inner or left.  Both sides are moved to the tasks of the plan and meet there without another
    shuffle; non-key columns of ``small`` whose
    names clash with those of ``big`` get the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    plan = plan or plan_fragments(big, keys)
    clash = [c for c in small.columns if c in big.columns and c not in keys]
    for c in clash:
        small = small.withColumnRenamed(c, f"{c}_right")
    left = place(big, plan, salt)
    right = _marked(small, plan)
    tasks = F.when(F.col(_HEAVY).isNull(), F.array("__fr_bt")).otherwise(F.array_distinct(_HEAVY))
    right = right.withColumn(_TASK, F.explode(tasks)).drop(_BIN, "__fr_bt", _HEAVY).repartitionById(plan.tasks, F.col(_TASK))
    return left.join(right, [*keys, _TASK], how).drop(_TASK)
