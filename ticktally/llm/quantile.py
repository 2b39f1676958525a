"""Percentiles of very large columns: deterministic collapsing of weighted buffers.

A sketch has ``raw`` values of weight 1 (fewer than k) and sorted buffers of exactly k values
with a weight that is a power of two, at most one per weight.  k raw values make a buffer of
weight 1.  Two buffers of the same weight w are collapsed: their merged order is thinned to
every second value, with weight 2w.  Keeping the first of each two overstates a rank by at
most w, keeping the second understates it by at most w; the choice alternates, and the sums
``over`` and ``under`` of these w are carried, so every sketch certifies its own bounds:

    estimate - over <= true rank <= estimate + under.

The schedule is a binary tree: n values cost at most log2(n/k) levels of n/(2k) each, that is
``under, over <= n/(2k) * log2(n/k)`` for any order of arrival and any split into partitions.

Sketches add: raw values and buffers are pooled and equal weights collapsed again.  They are
kept per day and combined for longer spans.  Sketches meet in a tree: at every level at most
``FAN_IN`` pieces are pooled in a row, and there are as many levels as the number of pieces needs.
Groups that stay below k values pass through the Arrow pass of a level untouched.

Cases: null, NaN, infinite and negative values are left out, zeros and ties stay; groups
without values have no sketch; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
FAN_IN = 64
CHUNK = 200_000
SKETCH = "n bigint, over bigint, under bigint, raw array<double>, buffers array<struct<w: bigint, v: array<double>>>"
_BUFFERS = pa.list_(pa.struct([("w", pa.int64()), ("v", pa.list_(pa.float64()))]))
_FIELDS = [("n", pa.int64()), ("over", pa.int64()), ("under", pa.int64()), ("raw", pa.list_(pa.float64())), ("buffers", _BUFFERS)]


class Sketch:
    """See the module's text."""

    def __init__(self, k: int, n: int = 0, over: int = 0, under: int = 0, raw: np.ndarray | None = None):
        self.k, self.n, self.over, self.under = k, n, over, under
        self.raw = np.empty(0) if raw is None else raw
        self.buffers: dict[int, np.ndarray] = {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.raw = np.concatenate([self.raw, values])
        self._fill()

    def _fill(self) -> None:
        whole = len(self.raw) // self.k * self.k
        for at in range(0, whole, self.k):
            self.push(1, np.sort(self.raw[at : at + self.k]))
        if whole:
            self.raw = self.raw[whole:].copy()

    def push(self, w: int, v: np.ndarray) -> None:
        while w in self.buffers:
            both = np.sort(np.concatenate([self.buffers.pop(w), v]), kind="stable")
            if self.over <= self.under:
                v, self.over = both[0::2], self.over + w
            else:
                v, self.under = both[1::2], self.under + w
            w *= 2
        self.buffers[w] = v

    def absorb(self, over: int, under: int, n: int, raw: np.ndarray, buffers: list[tuple[int, np.ndarray]]) -> None:
        self.over, self.under = self.over + over, self.under + under
        self.n += n
        for w, v in sorted(buffers, key=lambda x: x[0]):
            self.push(w, v)
        self.raw = np.concatenate([self.raw, raw])
        self._fill()

    def rank_below(self, x: float) -> int:
        """Estimated number of values < x."""
        return int((self.raw < x).sum()) + sum(w * int(np.searchsorted(v, x, "left")) for w, v in self.buffers.items())

    def row(self) -> dict:
        return {"n": self.n, "over": self.over, "under": self.under, "raw": np.sort(self.raw), "buffers": [{"w": w, "v": v} for w, v in sorted(self.buffers.items())]}


def partial_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = CAPACITY) -> DataFrame:
    """Sketches of each partition's part of each group.  Small groups of a chunk leave as raw values, cut
    out of one sorted vector; only groups that fill a buffer get a Python object."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + SKETCH
    df = df.select(*keys, F.col(value).cast("double").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: dict[tuple, Sketch] = {}
        pending: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(pending)
            pending.clear()
            names = t.schema.names[:-1]
            code = np.zeros(t.num_rows, np.int64)
            for c in names:
                d = t.column(c).combine_chunks().dictionary_encode()
                code = np.unique(code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary))), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            code, v = code[order], np.asarray(t.column("__v").combine_chunks())[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[starts[1:], len(code)]
            small = ends - starts < k // 4
            for i in np.flatnonzero(~small):
                key = tuple(t.column(c)[int(order[starts[i]])].as_py() for c in names)
                full.setdefault(key, Sketch(k)).add(v[starts[i] : ends[i]])
            s, e = starts[small], ends[small]
            if len(s):
                sizes = e - s
                keep = np.repeat(small, ends - starts)
                first = pa.array(order[s])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                zero = pa.array(np.zeros(len(s), np.int64))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(s) + 1, np.int32)), pa.array([], _BUFFERS.value_type))
                cols = [t.column(c).take(first).combine_chunks() for c in names] + [pa.array(sizes.astype(np.int64)), zero, zero, pa.ListArray.from_arrays(offsets, pa.array(v[keep])), none]
                whole = pa.RecordBatch.from_arrays(cols, names=[*names, *(f for f, _ in _FIELDS)])
                for at in range(0, whole.num_rows, 20_000):
                    yield whole.slice(at, 20_000)

        rows = 0
        schema = None
        for b in batches:
            schema = b.schema
            pending.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield from flush()
                rows = 0
        if rows:
            yield from flush()
        if full:
            kinds_ = [(schema.field(i).name, schema.field(i).type) for i in range(len(schema) - 1)]
            yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in kinds_), key)) | s.row() for key, s in full.items()], pa.schema([*kinds_, *_FIELDS]))

    return df.mapInArrow(run, ddl)


def _pool(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("over").alias("over"), F.sum("under").alias("under"), F.flatten(F.collect_list("raw")).alias("raw"), F.flatten(F.collect_list("buffers")).alias("buffers"))


def _collapsed(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Bring pooled sketches back to their form; one pass, in which groups that stay raw are not touched."""
    names = [*keys, "n", "over", "under", "raw", "buffers"]
    df = df.withColumn("raw", F.sort_array("raw")).select(*names)
    ddl = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys) + ", " + SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([*((c, b.schema.field(c).type) for c in keys), *_FIELDS])
            at = {name: i for i, name in enumerate(b.schema.names)}
            full = pc.or_(pc.greater_equal(pc.list_value_length(b.column(at["raw"])), k), pc.greater(pc.list_value_length(b.column(at["buffers"])), 0))
            small = b.filter(pc.invert(full))
            if small.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(small.columns, schema)], schema=schema)
            for i in np.flatnonzero(np.asarray(full)).tolist():
                get = lambda c: b.column(at[c])[i]  # noqa: B023, E731
                s = Sketch(k)
                pieces = [(x["w"].as_py(), np.asarray(x["v"].values)) for x in get("buffers")]
                s.absorb(get("over").as_py(), get("under").as_py(), get("n").as_py(), np.asarray(get("raw").values), pieces)
                yield pa.RecordBatch.from_pylist([{c: get(c).as_py() for c in keys} | s.row()], schema)

    return df.mapInArrow(run, ddl)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], piece: Column, pieces: int, k: int = CAPACITY) -> DataFrame:
    """One sketch per group.  ``piece`` numbers the partial sketches of a group from 0 to ``pieces`` - 1; they meet
    level by level, at most ``FAN_IN`` of them in a row."""
    at = sketches.withColumn("__piece", piece.cast("bigint"))
    while pieces > FAN_IN:
        at = at.withColumn("__piece", F.floor(F.col("__piece") / FAN_IN))
        at = _collapsed(_pool(at, [*keys, "__piece"]), [*keys, "__piece"], k)
        pieces = -(-pieces // FAN_IN)
    return _collapsed(_pool(at, keys), keys, k)


def below(x: str) -> Column:
    """Estimated number of values of a sketch that are < x, as an expression over its columns."""
    raw = F.size(F.filter("raw", lambda v: v < F.col(x)))
    return raw + F.aggregate("buffers", F.lit(0).cast("bigint"), lambda acc, b: acc + b["w"] * F.size(F.filter(b["v"], lambda v: v < F.col(x))))


def percentiles(sketches: DataFrame, keys: Sequence[str], pcts: Sequence[int]) -> DataFrame:
    """(keys, n, pct, value, rank_error): the least retained value whose estimated rank reaches pct percent."""
    weighted = F.concat(F.transform("raw", lambda v: F.struct(v.alias("v"), F.lit(1).cast("bigint").alias("w"))), F.flatten(F.transform("buffers", lambda b: F.transform(b["v"], lambda v: F.struct(v.alias("v"), b["w"].alias("w"))))))
    s = sketches.select(*keys, "n", (F.greatest("over", "under") / F.col("n")).alias("rank_error"), F.array_sort(weighted).alias("s"))

    def value(pct: int) -> Column:
        walk = F.aggregate("s", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["c"] + x["w"]).alias("c"), F.when(a["v"].isNull() & ((a["c"] + x["w"]) * 100 >= F.col("n") * pct), x["v"]).otherwise(a["v"]).alias("v")))
        return walk["v"]

    out = F.array(*[F.struct(F.lit(p).alias("pct"), value(p).alias("value")) for p in pcts])
    return s.select(*keys, "n", "rank_error", F.explode(out).alias("p")).select(*keys, "n", "p.pct", "p.value", "rank_error")
