"""The three report kinds: filter, extract keys, aggregate, derive rates, percents, percentiles.

Filters and key checks run before timers are exploded.  Aggregates are partial on the map side
and shuffle on the report's keys only.  A timer report counts a request once per key: with
nested timers that is decided inside the request's row (is this the first of its timers with
this key?), with a flat timer table by an aggregate on (request, keys) that reuses the join's
partitioning; neither needs a shuffle of its own.  Grand totals are one row, joined to all; a
filter put on the report later can't reach them.  The histogram branch exists only if asked for.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import to_seconds
from ..functions.hist import ABOVE, BELOW, INSIDE, bucket
from ..functions.tags import all_of, first_tag
from ..plans.conf import Histogram, ReportConf
from .filters import key_names, request_filter, request_key, request_keys_present, timer_filter, timer_tag_names
from .source import Source

#: Measures of each kind: internal name -> (column stem, is a duration).
MEASURES = {
    "request": (("req", "req", False), ("time", "req_time", True), ("utime", "ru_utime", True), ("stime", "ru_stime", True), ("traffic", "traffic", False), ("mem", "memory", False)),
    "timer": (("req", "req", False), ("hit", "hit", False), ("time", "time", True), ("utime", "ru_utime", True), ("stime", "ru_stime", True)),
}
_TOTAL = {"req": "req_count", "hit": "hit_count", "memory": "memory_footprint"}


def in_window(source: Source, conf: ReportConf, as_of: str | None) -> Source:
    """Requests of the completed ticks of the window that ends at ``as_of``: a time (UTC), ``now``, or ``latest``, the
    end of the tick with the source's newest request (a table at rest has no open tick); all requests if it is None."""
    if as_of is None:
        return source
    at, tick = F.unix_seconds(F.col("ts")), conf.tick_sec
    whole = lambda c: F.floor(c / tick) * tick
    if as_of == "latest":
        last = source.requests.agg((whole(F.unix_seconds(F.max("ts"))) + tick).alias("__end"))  # one row
        r = source.requests.crossJoin(F.broadcast(last))
        return Source(r.where((at < F.col("__end")) & (at >= F.col("__end") - conf.window_sec)).drop("__end"), source.timers)
    end = whole(F.unix_timestamp(F.current_timestamp() if as_of == "now" else F.lit(as_of).cast("timestamp")))
    return source.where((at < end) & (at >= end - conf.window_sec))


def _prepared(source: Source, conf: ReportConf, time_unit: str) -> Source:
    return source.where(request_filter(conf, time_unit) & request_keys_present(conf))


def request_rows(source: Source, conf: ReportConf, time_unit: str = "s", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per counted request: keys and measures."""
    r = _prepared(source, conf, time_unit).requests
    keys = [request_key(k).alias(n) for k, n in zip(conf.keys, key_names(conf))]
    return r.select(*extra, *keys, F.lit(1).alias("req"), F.lit(1).alias("hits"), F.col("request_time_ns").alias("time"), F.col("ru_utime_ns").alias("utime"), F.col("ru_stime_ns").alias("stime"), F.col("traffic"), F.col("mem_used").alias("mem"))


def timer_rows(source: Source, conf: ReportConf, time_unit: str = "s", extra: tuple[str, ...] = (), gather: bool = False) -> DataFrame:
    """One row per counted timer: keys, measures, and ``req``, 1 for the first of a request's timers with these keys.

    With a flat timer table ``req`` is null: requests are then counted by ``request_id``.  ``gather`` brings the timers of
    a request together before the join, for an aggregate per request after it: the one shuffle serves both, whichever
    join is chosen, and nothing is hashed on the map side, where a request's timers seldom meet.
    """
    s = _prepared(source, conf, time_unit)
    names = key_names(conf)
    wanted = timer_tag_names(conf)
    of_request = [request_key(k).alias(n) for k, n in zip(conf.keys, names) if k.kind != "ttag"]
    of_timer = [(k, n) for k, n in zip(conf.keys, names) if k.kind == "ttag"]

    def counted(tags: Column) -> Column:
        return reduce(and_, [first_tag(tags, k.name).isNotNull() for k, _ in of_timer], timer_filter(conf, tags))

    if s.timers is not None:
        # the keys' values are taken out of the tags here, so that no array is shuffled
        t = s.timers.where(counted(F.col("tags"))).select("request_id", "hit_count", "value_ns", F.col("ru_utime_ns").alias("__u"), F.col("ru_stime_ns").alias("__s"), *[first_tag(F.col("tags"), k.name).alias(n) for k, n in of_timer])
        t = t.repartition("request_id") if gather else t
        j = s.requests.select("request_id", *extra, *of_request).join(t, "request_id")
        return j.select("request_id", *extra, *names, F.lit(None).cast("int").alias("req"), F.col("hit_count").alias("hit"), F.col("value_ns").alias("time"), F.col("__u").alias("utime"), F.col("__s").alias("stime"))
    kept = F.transform(
        F.filter("timers", lambda t: counted(t["tags"])),
        lambda t: F.struct(t["hit_count"].alias("hit"), t["value_ns"].alias("time"), t["ru_utime_ns"].alias("utime"), t["ru_stime_ns"].alias("stime"), F.array(*[first_tag(t["tags"], k.name) for k, _ in of_timer]).cast("array<string>").alias("k")),
    )
    tag_names = F.flatten(F.transform("timers", lambda t: t["tags"]["name"]))
    r = s.requests.where(all_of(tag_names, wanted)).select("request_id", *extra, *of_request, kept.alias("__kept")).where(F.size("__kept") > 0)
    r = r.select("request_id", *extra, *[n for k, n in zip(conf.keys, names) if k.kind != "ttag"], F.transform("__kept", lambda t: t["k"]).alias("__keys"), F.posexplode("__kept").alias("__i", "__t"))
    first = (F.array_position("__keys", F.col("__t.k")) == F.col("__i") + 1).cast("int")
    keyed = {n: F.get(F.col("__t.k"), F.lit(i)) for i, (_, n) in enumerate(of_timer)}
    return r.select("request_id", *extra, *[keyed.get(n, F.col(n)).alias(n) for n in names], first.alias("req"), "__t.hit", "__t.time", "__t.utime", "__t.stime")


def histogram_rows(rows: DataFrame, conf: ReportConf, by: list[str], quantize: bool = True, compat: str = "fixed") -> DataFrame:
    """(by, cls, id, cnt): requests weigh 1, timers their hits, at the mean time of a hit."""
    if conf.kind == "timer":
        value, weight = F.floor(F.col("time") / F.col("hit")).cast("bigint"), F.col("hit")
        rows = rows.where(F.col("hit") > 0)
    else:
        value, weight = F.col("time"), F.lit(1)
    b = rows.select(*by, bucket(value, conf.histogram, quantize, compat).alias("__b"), weight.alias("__w"))
    return b.groupBy(*by, F.col("__b.cls").alias("cls"), F.col("__b.id").alias("id")).agg(F.sum("__w").cast("bigint").alias("cnt"))


def percentile_columns(hist: DataFrame, conf: ReportConf, by: list[str], packet_text: bool = False, compat: str = "fixed") -> DataFrame:
    """One row per key: percentiles in seconds and the histogram's text.

    A key has at most as many rows here as the histogram has quantised buckets.
    """
    h = conf.histogram
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = whole.orderBy("cls", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumn("__n", F.sum("cnt").over(whole)).withColumn("__cum", F.sum("cnt").over(run))
    base = F.lit(h.low_ns)
    rank = {p: F.least(F.ceil(F.col("__n").cast("double") * F.lit(float(v)) / F.lit(100.0)).cast("bigint"), F.col("__n")) for p, v in conf.percentiles}
    at = {p: F.min(F.when((F.col("__cum") >= rank[p]), F.struct("cls", "id", "cnt", F.col("__cum").alias("cum")))) for p, _ in conf.percentiles}
    entry = F.struct("id", "cnt")
    cols = [F.first("__n").alias("__n"), *[at[p].alias(f"__{p}") for p, _ in conf.percentiles]]
    cols += [
        F.sort_array(F.collect_list(F.when(F.col("cls") == INSIDE, entry))).alias("__in"),
        F.coalesce(F.sum(F.when(F.col("cls") == BELOW, F.col("cnt"))), F.lit(0)).alias("__below"), F.coalesce(F.sum(F.when(F.col("cls") == ABOVE, F.col("cnt"))), F.lit(0)).alias("__above"),
    ]
    per = x.groupBy(*by).agg(*cols) if by else x.agg(*cols)
    out = []
    for p, _ in conf.percentiles:
        e = F.col(f"__{p}")
        need = rank[p] - (e["cum"] - e["cnt"])
        inner = F.when(need == e["cnt"], base + F.lit(h.width_ns) * e["id"]).otherwise(base + F.lit(h.width_ns) * (e["id"] - 1) + F.floor(F.lit(h.width_ns) * need / e["cnt"]).cast("bigint"))
        ns = F.when((rank[p] == 0) | (e["cls"] == BELOW), base).when(e["cls"] == ABOVE, F.lit(h.high_ns)).otherwise(inner)
        out.append(to_seconds(ns).alias(p))
    colon = ": " if packet_text else ":"
    parts = F.concat(
        F.transform("__in", lambda b: F.concat(b["id"].cast("string"), F.lit(colon), b["cnt"].cast("string"))),
        F.when(F.col("__below") > 0, F.array(F.concat(F.lit(f"min{colon}"), F.col("__below").cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("__above") > 0, F.array(F.concat(F.lit(f"max{colon}"), F.col("__above").cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    text = F.concat(F.lit(f"{h.text()};values=["), F.array_join(parts, ", "), F.lit("]")).alias("histogram_data")
    return per.select(*by, *out, text)


def derived(agg: DataFrame, conf: ReportConf, names: list[str]) -> DataFrame:
    """Values, rates over the whole configured window and percents of the totals, in report order."""
    measures = MEASURES[conf.kind]
    totals = agg.agg(*[F.sum(m).alias(f"__{m}") for m, _, _ in measures])  # one row
    out: list[Column] = [F.col(n) for n in names]
    for m, stem, timed in measures:
        value = to_seconds(F.col(m)) if timed else F.col(m)
        out += [value.alias(_TOTAL.get(stem, f"{stem}_total")), (value / F.lit(float(conf.window_sec))).alias(f"{stem}_per_sec"), F.try_divide(F.lit(100.0) * F.col(m), F.col(f"__{m}").cast("double")).alias(f"{stem}_percent")]
    return agg.crossJoin(F.broadcast(totals)).select(*out)


def packet_report(source: Source, conf: ReportConf, time_unit: str = "s", quantize: bool = True, compat: str = "fixed", histogram: bool = True) -> DataFrame:
    """Always one row, of zeros if nothing matches."""
    s = source.where(request_filter(conf, time_unit))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = [F.count(F.lit(1)).alias("req_count"), zero("request_time_ns").alias("t"), zero("ru_utime_ns").alias("u"), zero("ru_stime_ns").alias("s"), zero("traffic").alias("traffic"), zero("mem_used").alias("memory_footprint")]
    if s.timers is None:
        a = s.requests.agg(*sums, zero(F.size("timers")).alias("timer_count"))
    else:
        n = s.timers.select("request_id").join(s.requests.select("request_id"), "request_id", "left_semi").agg(F.count(F.lit(1)).alias("timer_count"))
        a = s.requests.agg(*sums).crossJoin(F.broadcast(n))
    out = a.select("req_count", "timer_count", to_seconds(F.col("t")).alias("time_total"), to_seconds(F.col("u")).alias("ru_utime_total"), to_seconds(F.col("s")).alias("ru_stime_total"), "traffic", "memory_footprint")
    if conf.histogram and histogram:
        rows = s.requests.select(F.col("request_time_ns").alias("time"))
        h = percentile_columns(histogram_rows(rows, conf, [], quantize, compat), conf, [], packet_text=True, compat=compat)
        out = out.join(F.broadcast(h), F.lit(True), "left")
    return out


def report(source: Source, conf: ReportConf, as_of: str | None = None, time_unit: str = "s", quantize: bool = True, compat: str = "fixed", columns: list[str] | None = None) -> DataFrame:
    """A report as a DataFrame.  ``columns`` limits the result; without a percentile or histogram column among
    them the histogram branch isn't planned at all."""
    source = in_window(source, conf, as_of)
    names = key_names(conf)
    hist_cols = [p for p, _ in conf.percentiles] + ["histogram_data"]
    wanted = conf.histogram is not None and (columns is None or any(c in hist_cols for c in columns))
    if conf.kind == "packet":
        out = packet_report(source, conf, time_unit, quantize, compat, wanted)
    else:
        measured = columns is None or any(c not in (*names, *hist_cols) for c in columns) or not wanted
        rows = request_rows(source, conf, time_unit) if conf.kind == "request" else timer_rows(source, conf, time_unit, gather=measured)
        out = None
        if measured:
            out = derived(aggregate_rows(rows, source, conf, names), conf, names)
        if wanted:
            h = percentile_columns(histogram_rows(rows, conf, names, quantize, compat), conf, names, compat=compat)
            out = h if out is None else out.join(h, names, "left")
    return out.select(*columns) if columns else out


def aggregate_rows(rows: DataFrame, source: Source, conf: ReportConf, by: list[str]) -> DataFrame:
    """Sums of the measures per ``by``; flat timers are first summed per request, on the join's partitioning."""
    names = [m for m, _, _ in MEASURES[conf.kind]]
    if conf.kind == "timer" and source.timers is not None:
        rows = rows.groupBy("request_id", *by).agg(*[F.sum(m).alias(m) for m in names if m != "req"]).withColumn("req", F.lit(1))
    return rows.groupBy(*by).agg(*[F.sum(m).cast("bigint").alias(m) for m in names])
