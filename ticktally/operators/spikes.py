"""Implausible readings per source: peaks over threshold, stuck runs, plausibility.

A *source* is a non-empty name with at least ``least`` distinct records.  A reading is flagged if

a. it is negative, NaN or infinite (any source or none), or, for a field with a ``bounded_by``
   field, above that field's reading in the same record where that one is itself no case;
b. it is a spike: more than ``factor`` times the highest (for fields in ``two_sided`` also less
   than 1/``factor`` of the lowest) non-zero reading of its source and field that is no case;
c. it belongs to ``stuck`` or more readings that follow each other and are exactly equal.

Zero means "not sent".  How spikes are told from a source's normal tail:  readings are counted
per source, field, hour of day and 1/16 octave, with each bin's exact least and greatest value
(a summary of bounded size, combined on the map side).  Hourly means of the logarithm, shrunk
towards the source's own mean, give the season.

*Peaks over threshold.*  Take a place in the upper half of the readings.  To the residuals on its
inner side that exceed a threshold a generalised Pareto law is fitted by probability-weighted
moments (an exponential one, of shape 0, where there are fewer than ``few_peaks`` peaks).  The
threshold is the 90th percentile, or the highest lower one of ``PEAKS`` with ``few_peaks`` peaks
above it; where the law doesn't fit (Kolmogorov's distance at 5 %), higher ones are tried, and
the last is kept.  The cutoff at the fixed risk of ``risk`` expected readings per source selects
the candidates: a place is possible only if all readings on its outer side lie beyond it.

*Factor.*  Of possible places those count at which neighbouring readings lie more than ``factor``
apart, measured on values, so that rule (b) holds by construction; fewer than the share
``minority`` of the readings may be outside.  The innermost such place divides normal from spike.

*Regimes.*  A law fitted to the inner readings says nothing on a second component, so a group of
readings between two such places may be another regime of the source, and spikes lie beyond
all regimes.  A regime is dense (``regime_density`` readings an octave, within ``regime_octaves``,
not all equal) and either near (less than ``regime_gap`` octaves from the normal readings before it,
with ``regime_size`` readings, ``regime_share`` of the source and ``regime_part`` of all that is
outside) or large (``far_size`` readings and ``far_share`` of the source).  Where a source has few
readings, a few slow ones of a regime can't be told from spikes.

Stuck runs need the global order of each source.  Rows are range-partitioned by source, time
and record, which splits a hot source over many tasks; runs are found within partitions, and
the two edge runs of each partition, one row per partition and field, are joined up as a table.

Cases: null sources only take part in (a); null readings are skipped and don't break a run, a
zero breaks one; copies of a record count once; ties in time are ordered by record; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, parallelism
from .dedup import distinct_rows
from .skew import fragment_join, plan_fragments

BINS = 16  # a 16th of an octave
PIECE_ROWS = 400_000  # of a range partition, which one Python worker holds as vectors
PEAKS = (0.5, 0.75, 0.9, 0.95, 0.98)  # thresholds, as shares of the inner readings
START = 2  # the threshold that is tried first
BROADCAST_ROWS = 50_000  # of cutoffs or partitions; beyond that the joins shuffle


@dataclass(frozen=True)
class SpikeRules:
    record: str = "request_id"
    source: str = "hostname"
    time: str = "ts"
    fields: tuple[str, ...] = ("request_time", "ru_utime", "memory_footprint")
    two_sided: tuple[str, ...] = ("memory_footprint",)
    bounded_by: tuple[tuple[str, str], ...] = (("ru_utime", "request_time"),)
    least: int = 20
    factor: float = 2.0
    stuck: int = 8
    risk: float = 1.0
    few_peaks: int = 5
    minority: float = 0.5
    regime_octaves: float = 4.0
    regime_density: float = 2.5
    regime_gap: float = 3.0
    regime_size: int = 3
    regime_share: float = 0.02
    regime_part: float = 0.3
    far_size: int = 8
    far_share: float = 0.1


# --- stuck runs -------------------------------------------------------------------------------


def _runs(source: np.ndarray, value: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a reading, run number of each, length of each run)."""
    rows = np.flatnonzero(valid)
    if not len(rows):
        return rows, rows, rows
    s, v = source[rows], value[rows]
    new = np.empty(len(rows), bool)
    new[0], new[1:] = True, (s[1:] != s[:-1]) | ~(v[1:] == v[:-1])
    number = np.cumsum(new) - 1
    return rows, number, np.bincount(number)


def _columns(t: pa.Table, fields: tuple[str, ...]) -> tuple[np.ndarray, pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """Codes of the sources (-1 for null), the names they stand for, and values and validity of each field."""
    named = t.column("source").combine_chunks().dictionary_encode()
    source = np.asarray(named.indices.fill_null(-1), dtype=np.int64)
    out = []
    for f in fields:
        c = t.column(f).combine_chunks()
        valid = np.asarray(c.is_valid()) & (source >= 0)
        out.append((np.asarray(c.fill_null(0.0), dtype=np.float64), valid))
    return source, named.dictionary, out


_EDGES = "pid int, field string, s0 string, v0 double, n0 bigint, s1 string, v1 double, n1 bigint, single boolean"


def _edge_runs(ordered: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """First and last run of every partition and field: source, value, length, and whether they are the same run."""
    schema = pa.schema([("pid", pa.int32()), ("field", pa.string()), ("s0", pa.string()), ("v0", pa.float64()), ("n0", pa.int64()), ("s1", pa.string()), ("v1", pa.float64()), ("n1", pa.int64()), ("single", pa.bool_())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, state = 0, {}
        for b in batches:  # batch by batch: only the edge runs are kept
            if not b.num_rows:
                continue
            pid = b.column(0)[0].as_py()
            source, names, cols = _columns(pa.Table.from_batches([b]), fields)
            for f, (v, ok) in zip(fields, cols):
                rows, number, n = _runs(source, v, ok)
                if not len(rows):
                    continue
                starts = np.searchsorted(number, np.arange(len(n)))
                for k in ([0, len(n) - 1] if len(n) > 1 else [0]):
                    run = [names[int(source[rows[starts[k]]])].as_py(), float(v[rows[starts[k]]]), int(n[k])]
                    st = state.setdefault(f, [])
                    if st and k == 0 and st[-1][0] == run[0] and st[-1][1] == run[1]:
                        st[-1][2] += run[2]
                    else:
                        st.append(run)
                state[f] = [state[f][0], state[f][-1]] if len(state[f]) > 1 else state[f]
        out = [dict(zip(schema.names, (pid, f, *st[0], *st[-1], len(st) == 1))) for f, st in state.items()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.select("pid", "source", *fields).mapInArrow(edges, _EDGES)


def _full_lengths(edges: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(pid, first_<field>, last_<field>): whole lengths of the runs at the edges of each partition.

    The edge runs of a field in order; equal neighbours are one run.  A partition that is one run counts once.
    """
    run = lambda which: F.struct(F.lit(which == "last").alias("last"), F.col("s1" if which == "last" else "s0").alias("s"), F.col("v1" if which == "last" else "v0").alias("v"), F.when(F.col("single") & F.lit(which == "last"), 0).otherwise(F.col("n1" if which == "last" else "n0")).alias("n"))
    runs = edges.select("pid", "field", "single", F.explode(F.array(run("first"), run("last"))).alias("r")).select("pid", "field", "single", "r.*")
    order = Window.partitionBy("field").orderBy("pid", "last")
    # between a partition's first and last run there are others, unless they are the same
    new = F.when(F.col("last"), ~F.col("single")).otherwise((F.lag("s").over(order) != F.col("s")) | (F.lag("v").over(order) != F.col("v")))
    new = F.coalesce(new, F.lit(True))
    runs = runs.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    runs = runs.withColumn("total", F.sum("n").over(Window.partitionBy("field", "island")))
    return runs.groupBy("pid").agg(*[F.max(F.when((F.col("field") == f) & (F.col("last") == last), F.col("total"))).alias(f"__{name}_{f}") for f in fields for name, last in (("first", False), ("last", True))])


def stuck_flags(ordered: DataFrame, rules: SpikeRules) -> DataFrame:
    """Add ``stuck_<field>`` to rows range-partitioned and sorted by source, time, record, with their partition in ``pid`` (and cut)."""
    fields = rules.fields
    full = cut(_full_lengths(_edge_runs(ordered, fields), fields))
    kept = [c for c in ordered.columns if c != "pid"]
    if full.count() <= BROADCAST_ROWS:
        rows = ordered.join(F.broadcast(full), "pid", "left")  # keeps the order
    else:
        rows = ordered.join(full, "pid", "left").repartition("pid").sortWithinPartitions("pid", "source", "time", "record")
    ends = [f"__{name}_{f}" for f in fields for name in ("first", "last")]
    ddl = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", stuck_{f} boolean" for f in fields)

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        source, _, cols = _columns(t, fields)
        out = t.select(kept)
        for f, (v, ok) in zip(fields, cols):
            rows, number, n = _runs(source, v, ok)
            flags = np.zeros(t.num_rows, bool)
            if len(rows):
                n = n.copy()
                first, last = (t.column(f"__{name}_{f}")[0].as_py() or 0 for name in ("first", "last"))
                n[0], n[-1] = max(n[0], first), max(n[-1], last)
                flags[rows] = (n[number] >= rules.stuck) & (v[rows] != 0)
            out = out.append_column(f"stuck_{f}", pa.array(flags))
        yield from out.to_batches(max_chunksize=20_000)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one range partition
        for b in batches:
            pids = np.asarray(b.column(0))
            for at in np.split(np.arange(len(pids)), np.flatnonzero(np.diff(pids)) + 1):
                if len(at):
                    if held and held[-1].column(0)[0].as_py() != pids[at[0]]:
                        yield from one(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(int(at[0]), len(at)))
        if held:
            yield from one(pa.Table.from_batches(held))

    return rows.select("pid", *kept, *ends).mapInArrow(flag, ddl)


# --- tails ------------------------------------------------------------------------------------


def _pareto(y: np.ndarray, w: np.ndarray, few: int) -> tuple[float, float, float]:
    """(shape, scale, Kolmogorov's distance) of a generalised Pareto law fitted by probability-weighted
    moments to excesses ``y`` (in order) with weights ``w``; shape 0 if there are fewer than ``few``."""
    n = w.sum()
    share = np.cumsum(w) / n
    below = share - w / (2 * n)
    b0, b1 = float((y * w).sum() / n), float((y * w * (1 - below)).sum() / n)
    shape = 0.0
    if n >= few and b0 - 2 * b1 > 1e-12:
        shape = float(np.clip(2 - b0 / (b0 - 2 * b1), -0.5, 0.5))  # Hosking and Wallis, with shape = xi
    scale = max(b0 * (1 - shape), 1e-9)
    z = np.maximum(1 + shape * y / scale, 1e-12)
    law = 1 - (np.exp(-y / scale) if abs(shape) < 1e-6 else z ** (-1 / shape))
    return shape, scale, float(np.abs(law - below).max())


def cutoff(residual: np.ndarray, count: np.ndarray, rules: SpikeRules) -> float:
    """The residual beyond which ``risk`` of the given readings is expected, by peaks over a threshold."""
    order = np.argsort(residual, kind="stable")
    x, w = residual[order], count[order].astype(float)
    rank = np.cumsum(w) / w.sum()
    thresholds = [x[min(len(x) - 1, int(np.searchsorted(rank, q)))] for q in PEAKS]
    peaks = [float(w[x > u].sum()) for u in thresholds]
    first = START
    while first and peaks[first] < rules.few_peaks:
        first -= 1
    shape = scale = 0.0
    u, m = x[-1], 1.0
    for i in range(first, len(PEAKS)):
        if peaks[i] <= 0 or i > first and peaks[i] < rules.few_peaks:
            break
        u, m = thresholds[i], peaks[i]
        over = x > u
        shape, scale, distance = _pareto(x[over] - u, w[over], rules.few_peaks)
        if distance <= 1.36 / np.sqrt(m) + 0.5 / m:
            break
    p = min(1.0, rules.risk / m)
    return float(u + (scale * -np.log(p) if abs(shape) < 1e-6 else scale / shape * (p**-shape - 1)))


def tail_limit(low: np.ndarray, high: np.ndarray, residual: np.ndarray, count: np.ndarray, rules: SpikeRules) -> float | None:
    """The least reading of the upper tail that is a spike, or None.

    Bins: least and greatest log2 reading, mean residual of the bin's readings, their count.
    """
    # one entry per bin over all hours for the gaps, in order of size
    order = np.argsort(low, kind="stable")
    low, high, residual, count = low[order], high[order], residual[order], count[order]
    total = count.sum()
    top = np.maximum.accumulate(high)
    outer = total - np.cumsum(count)  # readings after each entry
    gap = low[1:] - top[:-1]
    wide = gap > np.log2(rules.factor)
    places = np.flatnonzero(wide & (outer[:-1] < rules.minority * total))
    first = 0  # of the places that lie beyond all regimes
    for i, k in enumerate(places):  # the group between this gap and the next
        end = places[i + 1] if i + 1 < len(places) else len(low) - 1
        size, spread = outer[k] - outer[end], high[k + 1 : end + 1].max() - low[k + 1]
        near = low[k + 1] - top[places[first]] < rules.regime_gap and size >= max(rules.regime_size, rules.regime_share * total, rules.regime_part * outer[k])
        if 0 < spread < min(rules.regime_octaves, (size - 1) / rules.regime_density) and (near or size >= max(rules.far_size, rules.far_share * total)):
            first = i + 1
    for k in places[first:]:  # innermost first
        if residual[k + 1 :].min() > cutoff(residual[: k + 1], count[: k + 1], rules):
            return float(low[k + 1])
    return None


def _limits_of(bins: list[dict], field: str, rules: SpikeRules) -> tuple[float | None, float | None]:
    own = [b for b in bins if b["field"] == field]
    if not own:
        return None, None
    hour, n = np.array([b["hour"] for b in own]), np.array([b["n"] for b in own], dtype=float)
    lo, hi = np.array([b["least"] for b in own]), np.array([b["most"] for b in own])
    llo, lhi = np.log2(lo), np.log2(hi)
    mid = (llo + lhi) / 2
    order = np.argsort(mid)
    centre = mid[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
    season = np.zeros(24)
    near = np.abs(mid - centre) < 4  # a season is estimated without the far tails
    for h in range(24):
        at = near & (hour == h)
        if at.any():
            k = n[at].sum()
            season[h] = ((mid[at] * n[at]).sum() / k - (mid[near] * n[near]).sum() / n[near].sum()) * k / (k + 30)
    residual = mid - season[hour]
    high_log = tail_limit(llo, lhi, residual, n, rules)
    high = None if high_log is None else float(lo[llo >= high_log - 1e-12].min())
    low = None
    if field in rules.two_sided:
        low_log = tail_limit(-lhi, -llo, -residual, n, rules)
        low = None if low_log is None else float(hi[-lhi >= low_log - 1e-12].max())
    return low, high


def source_limits(flagged: DataFrame, rules: SpikeRules) -> DataFrame:
    """One row per source with enough records: (source, low_<field>, high_<field>...)."""
    plain = {f: (F.col(f).cast("double") > 0) & (F.col(f).cast("double") < float("inf")) & ~F.col(f"stuck_{f}") for f in rules.fields}
    for f, by in rules.bounded_by:
        bound = F.col(by).cast("double")
        plain[f] = plain[f] & ~F.coalesce((F.col(f).cast("double") > bound) & (bound >= 0) & ~F.col(f"stuck_{by}"), F.lit(False))
    entries = [F.when(plain[f], F.struct(F.lit(f).alias("field"), F.floor(F.log2(F.col(f).cast("double")) * BINS).cast("int").alias("bin"), F.hour("time").alias("hour"), F.col(f).cast("double").alias("value"))) for f in rules.fields]
    entries.append(F.struct(F.lit("").alias("field"), F.lit(0).alias("bin"), F.lit(0).alias("hour"), F.lit(0.0).alias("value")))
    e = flagged.where(F.col("source") != "").select("source", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("source", "e.*")
    bins = e.groupBy("source", "field", "bin", "hour").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    per = bins.groupBy("source").agg(F.sum(F.when(F.col("field") == "", F.col("n"))).alias("records"), F.collect_list(F.when(F.col("field") != "", F.struct("field", "hour", "n", "least", "most"))).alias("bins"))
    per = per.where(F.col("records") >= rules.least)
    names = [f"{side}_{f}" for f in rules.fields for side in ("low", "high")]
    schema = pa.schema([("source", pa.string()), *[(n, pa.float64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, own in zip(b.column("source").to_pylist(), b.column("bins")):
                row: dict = {"source": source}
                bins = own.as_py()
                for f in rules.fields:
                    row[f"low_{f}"], row[f"high_{f}"] = _limits_of(bins, f, rules)
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return per.select("source", "bins").mapInArrow(run, "source string, " + ", ".join(f"{n} double" for n in names))


# --- all --------------------------------------------------------------------------------------


def impossible(v: Column) -> Column:
    """Negative, NaN or infinite."""
    return (v < 0) | F.isnan(v) | (v == float("inf"))


def stuck_rows(df: DataFrame, rules: SpikeRules = SpikeRules()) -> tuple[DataFrame, SpikeRules]:
    """Distinct records (record, source, time, fields) with their ``stuck_<field>``."""
    r = rules
    rows = distinct_rows(df, [r.record, r.time, r.source, *r.fields])
    rows = rows.select(F.col(r.record).alias("record"), F.col(r.source).alias("source"), F.col(r.time).alias("time"), *[F.col(f).cast("double").alias(f) for f in r.fields])
    pieces = max(parallelism(df.sparkSession), -(-df.count() // PIECE_ROWS))
    ordered = cut(rows.repartitionByRange(pieces, "source", "time", "record").sortWithinPartitions("source", "time", "record").withColumn("pid", F.spark_partition_id()))
    return stuck_flags(ordered, r), r


def implausible(df: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(record, field_name) of every implausible reading."""
    flagged, r = stuck_rows(df, rules)
    flagged = cut(flagged)
    limits = cut(source_limits(flagged, r).withColumn("has_limits", F.lit(True)))
    if limits.count() <= BROADCAST_ROWS:
        joined = flagged.join(F.broadcast(limits), "source", "left")
    else:
        joined = fragment_join(flagged, limits, ["source"], ["record"], "left", plan_fragments(flagged.select("source"), ["source"]))
    # a source without enough records has no row of limits, hence neither spikes nor stuck cases
    qualified = F.coalesce("has_limits", F.lit(False))
    case = {}
    for f in [x for x in r.fields if x not in dict(r.bounded_by)] + [x for x, _ in r.bounded_by]:
        v = F.col(f)
        spike = (v != 0) & (F.coalesce(v >= F.col(f"high_{f}"), F.lit(False)) | F.coalesce(v <= F.col(f"low_{f}"), F.lit(False)))
        case[f] = impossible(v) | (qualified & (spike | F.col(f"stuck_{f}")))
        if f in dict(r.bounded_by):
            by = dict(r.bounded_by)[f]
            case[f] = case[f] | F.coalesce((v > F.col(by)) & ~F.coalesce(case[by], F.lit(False)), F.lit(False))
    found = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & case[f], F.lit(f)) for f in r.fields]))
    return joined.select(F.col("record").alias(r.record), F.explode(found).alias("field_name"))
