"""Queries of the wire path, of the engine's views and system tables, and of SQL over reports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import asof_join
from ..operators.report import report
from ..operators.source import Source
from ..sources import wire
from ..sources.adapt import from_orders
from .conf import parse_report_conf
from .engine import STATS, Engine
from .reports import ORACLES as REPORT_ORACLES
from .reports import REQ, TIM, WINDOW, hist_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- datagrams -----------------------------------------------------------------------------------

FAULTS = 23  # of so many requests one each has the faults below


def _spoiled(m: dict, k: int) -> dict:
    """Messages with a fault, by the request's number."""
    fault = k % FAULTS
    if fault == 0:
        return m | {"status": 2**32 - 1}
    if fault == 1:
        return m | {"timer_hit_count": [*m["timer_hit_count"], 1]}
    if fault == 2:
        return m | {"request_time": float("nan")}
    if fault == 3:
        return m | {"timer_tag_count": [*m["timer_tag_count"], 1]}
    if fault == 4:
        return {n: v for n, v in m.items() if n != "hostname"}
    if fault == 5:
        return m | {"tag_name": [*m["tag_name"], 10**6], "tag_value": [*m["tag_value"], 0]}
    if fault == 6:
        return m | {"ru_utime": -1.0}
    return m


def datagrams(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, datagram): requests made of orders as datagrams in all framings, some with faults."""
    r = from_orders(spark, d).requests
    plain = lambda tags: F.filter(tags, lambda t: t["name"] != "-")
    r = r.withColumn("tags", plain(F.col("tags"))).withColumn("timers", F.transform("timers", lambda t: t.withField("tags", plain(t["tags"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            raw = [wire.frame(wire.encode_message(_spoiled(wire.message_of(x), x["request_id"])), x["request_id"] % 3) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array(raw, pa.binary())], names=["request_id", "datagram"])

    return r.mapInArrow(run, "request_id bigint, datagram binary")


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return wire.decode(datagrams(spark, d), "datagram", ["request_id"])


def _ingested(spark: SparkSession, d: str) -> Source:
    return wire.ingest(_decoded(spark, d).withColumn("ts", F.lit("2030-01-01").cast("timestamp")), "request_id", "ts")


_RESULT = f"""case request_id % {FAULTS} when 0 then 'status_is_too_large' when 1 then 'bad_hit_count' when 2 then 'bad_float_request_time'
 when 3 then 'bad_tag_count' when 4 then 'packet_decode_err' when 5 then 'bad_dictionary_offset' else 'okay' end"""
_f32 = lambda c: f"trunc(({c}::double / 1e9)::float::double * 1e9)::bigint"

QUERIES["wire_rejections"] = lambda spark, d: wire.rejections(_decoded(spark, d))
ORACLES["wire_rejections"] = f"with {REQ} select {_RESULT} as result, count(*) packets from req group by 1"
QUERIES["wire_requests"] = lambda spark, d: _ingested(spark, d).requests.select(
    "request_id", "host", "server", "script", "schema", "status", "traffic", "mem_used", "request_time_ns", "ru_utime_ns", "ru_stime_ns", F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["name"], t["value"])), ";").alias("tags")
)
ORACLES["wire_requests"] = f"""with {REQ} select request_id, host, server, script, schema, status, traffic, mem as mem_used, {_f32('t')} request_time_ns,
 case when request_id % {FAULTS} = 6 then 0 else {_f32('u')} end ru_utime_ns, {_f32('s')} ru_stime_ns,
 array_to_string(list_filter([case when request_id % 11 <> 0 then 'app=' || app end, case when request_id % 13 = 0 then 'app=app-again' end, 'prio=' || prio], lambda x: x is not null), ';') tags
 from req where {_RESULT} = 'okay'"""
QUERIES["wire_timers"] = lambda spark, d: (
    _ingested(spark, d)
    .requests.select("request_id", F.explode("timers").alias("t"))
    .groupBy("request_id")
    .agg(F.count(F.lit(1)).alias("timers"), F.sum("t.hit_count").alias("hits"), F.sum("t.value_ns").alias("value_ns"), F.sum("t.ru_utime_ns").alias("utime_ns"), F.count_if(F.array_contains("t.tags.name", "state")).alias("states"), F.sum(F.size("t.tags")).cast("bigint").alias("tags"))
)
ORACLES["wire_timers"] = f"""with {REQ}, {TIM}, ok as (select request_id from req where {_RESULT} = 'okay')
 select request_id, count(*) timers, sum(hit)::bigint hits, sum({_f32('t')})::bigint value_ns, sum({_f32('u')})::bigint utime_ns, count(state) states,
  sum(2 + (state is not null)::int + (l_partkey % 19 = 0)::int)::bigint tags
 from ok join (select tim.*, l_partkey from (select *, row_number() over () rn from tim) tim join (select l_partkey, row_number() over () rn from lineitem) l using (rn)) using (request_id) group by request_id"""
_WIRE = parse_report_conf(f"v2/timer/{WINDOW}/@supp,~script/no_percentiles/no_filters")
QUERIES["wire_report"] = lambda spark, d: report(_ingested(spark, d), _WIRE, columns=["supp", "script", "req_count", "hit_count"])
ORACLES["wire_report"] = f"with {REQ}, {TIM} select supp, script, count(distinct request_id) req_count, sum(hit)::bigint hit_count from req join tim using (request_id) where {_RESULT} = 'okay' group by supp, script"

# --- views of the engine -------------------------------------------------------------------------

_DAYS = 30
_IN = "(select max(o_orderdate)::date from orders)"
_WINDOWED = f"ts < {_IN} + interval 1 day and ts >= {_IN} - interval {_DAYS - 1} day"


def _view(spark: SparkSession, d: str, name: str, text: str, columns: list[str], flat: bool = True) -> DataFrame:
    """What a select over the report's view gives."""
    engine = Engine(spark, from_orders(spark, d, flat=flat))
    engine.create_report(name, text)
    out = spark.table(name).select(*columns)
    engine.drop_report(name)
    return out


QUERIES["view_window_request"] = lambda spark, d: _view(spark, d, "tt_request", f"v2/request/{86400 * _DAYS},86400/~script/no_percentiles/no_filters", ["script", "req_count", "req_per_sec", "req_percent", "traffic_total"])
ORACLES["view_window_request"] = f"""with {REQ}, w as (select * from req where {_WINDOWED}) select script, count(*) req_count, count(*)::double / {86400 * _DAYS} req_per_sec,
 100.0::double * count(*) / (select count(*) from w) req_percent, sum(traffic)::bigint traffic_total from w group by script"""
QUERIES["view_window_timer"] = lambda spark, d: _view(spark, d, "tt_timer", f"v2/timer/{86400 * _DAYS},86400/@flag,~status/no_percentiles/no_filters", ["flag", "status", "req_count", "hit_count", "hit_per_sec"])
ORACLES["view_window_timer"] = f"""with {REQ}, {TIM} select flag, status, count(distinct request_id) req_count, sum(hit)::bigint hit_count, sum(hit)::double / {86400 * _DAYS} hit_per_sec
 from req join tim using (request_id) where {_WINDOWED} group by flag, status"""
QUERIES["view_window_percentiles"] = lambda spark, d: _view(spark, d, "tt_percentiles", f"v2/request/{86400 * _DAYS},86400/~host/hv=0:500:5000,p50,p99/no_filters", ["host", "p50", "p99", "histogram_data"])
_rows = f"select host, t v, 1 w from req where {_WINDOWED}"
ORACLES["view_window_percentiles"] = f"with {REQ}, {hist_sql(_rows, ['host'], 0, 100000, 5000, [('p50', 50.0), ('p99', 99.0)], 'hv=0:500:5000')}"

_OFFSET = parse_report_conf(f"v2/request/{WINDOW}/~host,~status/hv=100:500:400,p0,p50,p95,p100/no_filters")
_PCT = [("p0", 0.0), ("p50", 50.0), ("p95", 95.0), ("p100", 100.0)]
QUERIES["request_percentiles_offset"] = lambda spark, d: report(from_orders(spark, d, flat=True), _OFFSET, columns=["host", "status", *[p for p, _ in _PCT], "histogram_data"])
_rows = "select host, status, t - 100000000 v, 1 w from req"
ORACLES["request_percentiles_offset"] = f"with {REQ}, {hist_sql(_rows, ['host', 'status'], 100000000, 1000000, 400, _PCT, 'hv=100:500:400')}"

_REQUEST_TEXT, _TIMER_TEXT = f"v2/request/{WINDOW}/~host,+app/no_percentiles/min_time=0.1,+prio=1", f"v2/timer/{WINDOW}/~server,+app,@state/no_percentiles/@flag=R,~status=200"


def _active(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark, from_orders(spark, d, flat=True))
    engine.create_report("tt_a", _REQUEST_TEXT)
    engine.create_report("tt_b", _TIMER_TEXT)
    engine.create_report("tt_active", "v2/active")
    out = spark.table("tt_active").select("id", "table_name", "kind", "time_window_sec", "tick_count", *_COUNTED)
    for name in ("tt_a", "tt_b", "tt_active"):
        engine.drop_report(name)
    return out


_COUNTED = ("packets_received", "packets_aggregated", "packets_dropped_by_bloom", "packets_dropped_by_filters", "packets_dropped_by_rtag", "packets_dropped_by_rfield", "packets_dropped_by_timertag", "timers_scanned", "timers_aggregated")
QUERIES["active_reports"] = _active
ORACLES["active_reports"] = " union all ".join(
    f"select {i} as id, '{name}' as table_name, '{kind}' as kind, {WINDOW} as time_window_sec, {WINDOW} as tick_count, {', '.join(_COUNTED)} from ({REPORT_ORACLES[oracle]})"
    for i, name, kind, oracle in ((1, "tt_a", "request", "active_counters_request"), (2, "tt_b", "timer", "active_counters_timer"))
)

_STATUS = "Ticktally_"
QUERIES["status_like"] = lambda spark, d: Engine(spark, from_orders(spark, d)).status(_STATUS).where(F.col("Variable_name").like(f"{_STATUS}udp%")).select("Variable_name")
ORACLES["status_like"] = f"select name as Variable_name from (select unnest([{', '.join(repr(_STATUS + c.split()[0]) for c in STATS)}]) as name) where name like '{_STATUS}udp%'"

# --- keys with the names of columns ---------------------------------------------------------------


def _renamed(spark: SparkSession, d: str) -> Source:
    new = lambda c: F.when(c == "app", "traffic").when(c == "prio", "req_count").when(c == "supp", "time").otherwise(c)
    other = lambda tags: F.transform(tags, lambda t: F.struct(new(t["name"]).alias("name"), t["value"].alias("value")))
    r = from_orders(spark, d).requests
    return Source(r.withColumn("tags", other(F.col("tags"))).withColumn("timers", F.transform("timers", lambda t: t.withField("tags", other(t["tags"])))))


_RESERVED = parse_report_conf(f"v2/timer/{WINDOW}/@time,+traffic,+req_count/no_percentiles/no_filters")
QUERIES["report_reserved_keys"] = lambda spark, d: report(_renamed(spark, d), _RESERVED, columns=["time_2", "traffic_2", "req_count_2", "req_count", "hit_count", "time_total"])
ORACLES["report_reserved_keys"] = f"""with {REQ}, {TIM} select supp as time_2, app as traffic_2, prio as req_count_2, count(distinct request_id) req_count, sum(hit)::bigint hit_count, sum(tim.t)::bigint::double / 1e9 time_total
 from req join tim using (request_id) where app is not null group by supp, app, prio"""

# --- joins by time -------------------------------------------------------------------------------


def _asof(spark: SparkSession, d: str) -> DataFrame:
    """To every request the last earlier day on which its script had a request of status 500."""
    r = from_orders(spark, d, flat=True).requests.select("request_id", "script", "status", F.floor(F.unix_seconds("ts") / 86400).alias("day"))
    failed = r.where("status = '500'").select("script", F.col("day").alias("failed_day")).distinct()
    return asof_join(r.select("request_id", "script", "day"), failed, ["script"], "day", "failed_day", 64, strict=True)


QUERIES["report_asof_join"] = _asof
ORACLES["report_asof_join"] = f"""with {REQ}, r as (select request_id, script, status, epoch(ts)::bigint // 86400 as day from req), f as (select distinct script, day as failed_day from r where status = '500')
 select request_id, r.script, day, failed_day from r asof left join f on r.script = f.script and r.day > f.failed_day"""

# --- the rest of SQL over a report's view ----------------------------------------------------------

_COLUMNS = ["host", "script", "req_count", "traffic_total"]
_HOSTS = parse_report_conf(f"v2/request/{WINDOW}/~host,~script/no_percentiles/no_filters")
_VIEW = "v as (select host, script, count(*) req_count, sum(traffic)::bigint traffic_total from req group by host, script)"


def _rows_of(spark: SparkSession, d: str) -> DataFrame:
    return report(from_orders(spark, d, flat=True), _HOSTS, columns=_COLUMNS)


@F.pandas_udf(T.StringType())
def _label(script: pd.Series, count: pd.Series) -> pd.Series:
    """A user's function, a batch of rows at a time."""
    return script.str.replace("script-", "s", regex=False) + ":" + count.astype(str)


@F.pandas_udf(T.DoubleType())
def _middle(count: pd.Series) -> float:
    """A user's aggregate."""
    return float(count.median())


QUERIES["report_udf"] = lambda spark, d: _rows_of(spark, d).select("host", _label("script", "req_count").alias("label"))
ORACLES["report_udf"] = f"with {REQ}, {_VIEW} select host, replace(script, 'script-', 's') || ':' || req_count as label from v"
QUERIES["report_udaf"] = lambda spark, d: _rows_of(spark, d).groupBy("host").agg(_middle("req_count").alias("middle"))
ORACLES["report_udaf"] = f"with {REQ}, {_VIEW} select host, median(req_count)::double as middle from v group by host"
QUERIES["report_scalar_functions"] = lambda spark, d: _rows_of(spark, d).select(
    "host",
    F.regexp_extract("script", r"(\d+)$", 1).cast("int").alias("number"),
    F.concat_ws("/", "host", "script").alias("path"),
    F.round(F.sqrt("traffic_total"), 3).alias("root"),
    F.greatest("req_count", F.lit(75)).alias("least_75"),
    F.pmod("traffic_total", F.lit(97)).alias("rest"),
    F.date_format(F.date_add(F.lit("2030-01-31").cast("date"), F.col("req_count").cast("int")), "yyyy-MM-dd").alias("later"),
    F.size(F.split(F.concat_ws("-", "host", "script"), "-")).alias("parts"),
    F.get_json_object(F.to_json(F.struct("req_count")), "$.req_count").alias("json"),
)
ORACLES["report_scalar_functions"] = f"""with {REQ}, {_VIEW} select host, regexp_extract(script, '(\\d+)$', 1)::int number, host || '/' || script path, round(sqrt(traffic_total), 3) root, greatest(req_count, 75) least_75,
 traffic_total % 97 rest, strftime(date '2030-01-31' + req_count::int, '%Y-%m-%d') later, len(string_split(host || '-' || script, '-')) parts, req_count::varchar json from v"""
QUERIES["report_row_count"] = lambda spark, d: _rows_of(spark, d).agg(F.count(F.lit(1)).alias("report_rows"))
ORACLES["report_row_count"] = f"with {REQ} select count(distinct (host, script)) report_rows from req"


def _renamed_view(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark, from_orders(spark, d, flat=True))
    engine.create_report("tt_old", f"v2/request/{86400 * _DAYS},86400/~status/no_percentiles/no_filters")
    engine.rename_report("tt_old", "tt_new")
    out = spark.sql("select status, req_count from tt_new where req_count > 0")
    engine.drop_report("tt_new")
    return out


QUERIES["view_renamed"] = _renamed_view
ORACLES["view_renamed"] = f"with {REQ} select status, count(*) req_count from req where {_WINDOWED} group by status"
QUERIES["packet_debug"] = lambda spark, d: Engine(spark, from_orders(spark, d)).debug_packets(1.0).select(F.get_json_object("packet", "$.request_id").alias("request_id"), F.get_json_object("packet", "$.host").alias("host"))
ORACLES["packet_debug"] = f"with {REQ} select request_id::varchar request_id, host from req"
