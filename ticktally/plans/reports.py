"""Report queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counters import NAMES, counters
from ..operators.report import report
from ..operators.ticks import last_ticks, merged, tick_histograms, tick_table
from ..sources.adapt import from_events, from_metrics, from_orders
from .conf import LEGACY_REPORTS, ReportConf, legacy_report_conf, parse_report_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WINDOW = 86400

# --- SQL pieces -------------------------------------------------------------------------------

REQ = """req as (
 select o_orderkey request_id, o_orderdate ts, 'host-' || (o_custkey % 10) host, case when o_orderkey % 17 = 0 then '' else o_orderpriority end server, 'script-' || (o_orderkey % 20) script,
  case when o_orderkey % 2 = 0 then 'https' else 'http' end as schema, case o_orderstatus when 'F' then '200' when 'O' then '404' else '500' end status, o_orderkey % 5000 traffic, o_custkey * 1024 mem,
  round(o_totalprice * 1000)::bigint t, round(o_totalprice * 400)::bigint u, round(o_totalprice * 100)::bigint s,
  case when o_orderkey % 11 <> 0 then 'app-' || (o_custkey % 7) when o_orderkey % 13 = 0 then 'app-again' end app, substr(o_orderpriority, 1, 1) prio from orders)"""
TIM = """tim as (
 select l_orderkey request_id, l_quantity::bigint hit, round(l_extendedprice * 10000)::bigint t, round(l_discount * 1e9)::bigint u, round(l_tax * 1e9)::bigint s, l_returnflag flag,
  case when l_linenumber % 5 <> 0 then l_linestatus end state, 's' || (l_suppkey % 10) supp, l_partkey % 19 = 0 and l_returnflag <> 'X' as mixed from lineitem)"""
_DERIVED = {
    "request": (("req", "count(*)", "req_count", "req"), ("t", "sum(t)", "req_time_total", "req_time"), ("u", "sum(u)", "ru_utime_total", "ru_utime"), ("s", "sum(s)", "ru_stime_total", "ru_stime"), ("traffic", "sum(traffic)", "traffic_total", "traffic"), ("mem", "sum(mem)", "memory_footprint", "memory")),
    "timer": (("req", "count(distinct request_id)", "req_count", "req"), ("hit", "sum(hit)", "hit_count", "hit"), ("t", "sum(t)", "time_total", "time"), ("u", "sum(u)", "ru_utime_total", "ru_utime"), ("s", "sum(s)", "ru_stime_total", "ru_stime")),
}


def derived_sql(kind: str, rows: str, keys: list[str], window: int, extra: str = "", ctes: str = "") -> str:
    """A report over a subquery with columns of keys and measures."""
    g = ", ".join(keys)
    aggs = ", ".join(f"({f})::bigint as {m}" for m, f, _, _ in _DERIVED[kind])
    timed = {"t", "u", "s"}
    out = []
    for m, _, total, stem in _DERIVED[kind]:
        v = f"({m}::double / 1e9)" if m in timed else m
        out.append(f"{v} as {total}, {v}::double / {window}.0::double as {stem}_per_sec, case when (sum({m}) over ()) <> 0 then 100.0::double * {m}::double / (sum({m}) over ())::double end as {stem}_percent")
    return f"with {ctes}, base as ({rows}), agg as (select {g}, {aggs} from base group by {g}) select {g}, {', '.join(out)}{extra} from agg"


def _conf(kind: str, keys: str, hist: str = "no_percentiles", filters: str = "no_filters", window: int | str = WINDOW) -> ReportConf:
    return parse_report_conf(f"v2/{kind}/{window}/{keys}/{hist}/{filters}")


def _flat(spark: SparkSession, d: str):
    return from_orders(spark, d, flat=True)


def _add(name: str, conf: ReportConf, sql: str | None, source: Callable = from_orders, **kw) -> None:
    QUERIES[name] = lambda spark, d: report(source(spark, d), conf, **kw)
    if sql:
        ORACLES[name] = sql


# --- packet -----------------------------------------------------------------------------------

_PACKET = "count(*) as req_count, coalesce(sum((select count(*) from tim where tim.request_id = req.request_id)), 0)::bigint as timer_count, coalesce(sum(t), 0)::bigint::double / 1e9 as time_total, coalesce(sum(u), 0)::bigint::double / 1e9 as ru_utime_total, coalesce(sum(s), 0)::bigint::double / 1e9 as ru_stime_total, coalesce(sum(traffic), 0)::bigint as traffic, coalesce(sum(mem), 0)::bigint as memory_footprint"
for _name, _filters, _where in (
    ("packet_info", "no_filters", "true"),
    ("packet_filtered", "min_time=0.05,max_time=0.3,~status=200,+app=app-3", "t >= 50000000 and t < 300000000 and status = '200' and app = 'app-3'"),
    ("packet_nothing", "~host=nowhere", "host = 'nowhere'"),
):
    _sql = f"with {REQ}, {TIM} select {_PACKET} from req where {_where}"
    _add(_name, _conf("packet", "no_keys", filters=_filters), _sql, _flat)
    _add(f"{_name}_nested", _conf("packet", "no_keys", filters=_filters), _sql)

# --- request ----------------------------------------------------------------------------------


def _request(name: str, keys: str, filters: str = "no_filters", where: str = "true", window: int = WINDOW) -> None:
    conf = _conf("request", keys, filters=filters, window=window)
    cols = [k.lstrip("~+") for k in keys.split(",")]
    present = " and ".join(f"{k[1:]} is not null" for k in keys.split(",") if k[0] == "+") or "true"
    rows = f"select request_id, {', '.join(cols)}, t, u, s, traffic, mem from req where ({where}) and {present}"
    _add(name, conf, derived_sql("request", rows, cols, window, ctes=REQ), _flat)


for _f in ("host", "script", "server", "schema", "status"):
    _request(f"request_by_{_f}", f"~{_f}")
_request("request_by_host_script_status", "~host,~script,~status")
_request("request_by_rtag", "+app")
_request("request_by_host_rtags", "~host,+app,+prio")
_request("request_min_max_time", "~script", "min_time=0.1,max_time=0.25", "t >= 100000000 and t < 250000000")
_request("request_rtag_filter", "~host", "+app=app-2,+prio=1", "app = 'app-2' and prio = '1'")
_request("request_field_filters", "~script", "~schema=https,~status=404,~host=host-3", "schema = 'https' and status = '404' and host = 'host-3'")
for _n, _fields in LEGACY_REPORTS.items():
    _legacy = parse_report_conf(legacy_report_conf(f"{_n}::"))
    _cols = list(_fields)
    _add(f"legacy_{_n}", _legacy, derived_sql("request", f"select request_id, {', '.join(_cols)}, t, u, s, traffic, mem from req", _cols, 60, ctes=REQ), columns=[*_cols, *(c for m in _DERIVED["request"] for c in (m[2], f"{m[3]}_per_sec", f"{m[3]}_percent"))])

# --- timer ------------------------------------------------------------------------------------


def _timer(name: str, keys: str, filters: str = "no_filters", where: str = "true", flat: bool = False, window: int = WINDOW, conf: ReportConf | None = None) -> None:
    conf = conf or _conf("timer", keys, filters=filters, window=window)
    cols = [k.lstrip("~+@") for k in keys.split(",")]
    checks = [f"{k[1:]} is not null" for k in keys.split(",") if k[0] in "+@"] + [f"{k[1:]} <> ''" for k in keys.split(",") if k[0] == "~"]
    rows = f"select req.request_id, {', '.join(cols)}, hit, tim.t, tim.u, tim.s from req join tim using (request_id) where ({where}) and {' and '.join(checks)}"
    extra = [*cols, *(c for m in _DERIVED["timer"] for c in (m[2], f"{m[3]}_per_sec", f"{m[3]}_percent"))]
    _add(name, conf, derived_sql("timer", rows, cols, conf.window_sec, ctes=f"{REQ}, {TIM}"), (_flat) if flat else from_orders, columns=extra)


_timer("timer_by_tag", "@flag", flat=True)
_timer("timer_by_tag_nested", "@flag")
_timer("timer_two_tags", "@flag,@state", flat=True)
_timer("timer_mixed_keys", "@state,~host,+app,@supp", flat=True)
_timer("timer_mixed_keys_nested", "@state,~host,+app,@supp")
_timer("timer_by_server_tag", "~server,@flag", flat=True)
_timer("timer_tag_filter", "@state", "@flag=R", "flag = 'R' and not mixed", flat=True)
_timer("timer_tag_filter_nested", "@state", "@flag=R", "flag = 'R' and not mixed")
_timer("timer_request_filters", "@supp", "min_time=0.1,~status=200,+prio=2", "req.t >= 100000000 and status = '200' and prio = '2'", flat=True)
_timer("timer_no_tag_keys", "~script", flat=True)
for _n, _base in (("info", ""), ("report", "~script,"), ("report2", "~script,~host,~server,")):
    for _many, _tags in (("", "flag"), ("2", "flag,state"), ("N", "flag,state,supp")):
        _text = legacy_report_conf(f"tag{_many}_{_n}:{_tags}")
        _timer(f"legacy_tag{_many}_{_n}", _base + ",".join(f"@{t}" for t in _tags.split(",")), conf=parse_report_conf(_text), flat=True)
for _n, _base in (("info", ""), ("report", "~host,")):
    for _many, _tags in (("", "app"), ("2", "app,prio"), ("N", "prio,app")):
        _keys = _base + ",".join(f"+{t}" for t in _tags.split(","))
        _cols = [k.lstrip("~+") for k in _keys.split(",")]
        _add(f"legacy_rtag{_many}_{_n}", parse_report_conf(legacy_report_conf(f"rtag{_many}_{_n}:{_tags}")), derived_sql("request", f"select request_id, {', '.join(_cols)}, t, u, s, traffic, mem from req where app is not null", _cols, 60, ctes=REQ), columns=[*_cols, *(c for m in _DERIVED["request"] for c in (m[2], f"{m[3]}_per_sec", f"{m[3]}_percent"))])

QUERIES["timer_req_count_distinct"] = lambda spark, d: report(from_orders(spark, d), _conf("timer", "@supp"), columns=["supp", "req_count"])
ORACLES["timer_req_count_distinct"] = f"with {REQ}, {TIM} select supp, count(distinct req.request_id) req_count from req join tim using (request_id) group by supp"

# --- histograms -------------------------------------------------------------------------------


def hist_sql(rows: str, keys: list[str], low_ns: int, width: int, buckets: int, pcts: list[tuple[str, float]], head: str, packet: bool = False) -> str:
    """Percentiles and text of a histogram; ``rows`` has the keys, v (ns) and w (weight)."""
    g = "".join(f"{k}, " for k in keys)
    part = f"partition by {', '.join(keys)}" if keys else ""
    high = low_ns + width * buckets
    colon = ": " if packet else ":"
    cases = []
    for name, p in pcts:
        rank = f"least(ceil(n * {p}::double / 100.0::double)::bigint, n)"
        inner = f"(select min(struct_pack(cls := h2.cls, id := h2.id, cnt := h2.cnt, cum := h2.cum)) from h h2 where h2.cum >= {rank}{''.join(f' and h2.{k} is not distinct from o.{k}' for k in keys)})"
        cases.append((name, rank, inner))
    sel = ", ".join(f"{inner} as x_{name}, {rank} as r_{name}" for name, rank, inner in cases)
    val = ", ".join(
        f"(case when r_{n} = 0 or x_{n}.cls = -1 then {low_ns} when x_{n}.cls = 1 then {high} when r_{n} - x_{n}.cum + x_{n}.cnt = x_{n}.cnt then {low_ns} + {width} * x_{n}.id else {low_ns} + {width} * (x_{n}.id - 1) + ({width} * (r_{n} - x_{n}.cum + x_{n}.cnt)) // x_{n}.cnt end)::bigint::double / 1e9 as {n}" for n, _, _ in cases
    )
    return f"""v as (select {g}(v // {width} + case when v % {width} > 0 then 1 else 0 end) b, w from ({rows})),
 c as (select {g}case when b < 1 then -1 when b > {buckets} then 1 else 0 end cls, case when b between 1 and {buckets} then b - b % (1 << greatest(length(bin(b | 255)) - 8, 0)) else 0 end id, w from v),
 g as (select {g}cls, id, sum(w)::bigint cnt from c group by {g}cls, id),
 h as (select {g}cls, id, cnt, (sum(cnt) over ({part}))::bigint n, (sum(cnt) over ({part} order by cls, id rows unbounded preceding))::bigint cum from g),
 o as (select {g}any_value(n) n, '{head};values=[' || array_to_string(list_concat(coalesce(list(id || '{colon}' || cnt order by id) filter (cls = 0), []), coalesce(list('min{colon}' || cnt) filter (cls = -1), []), coalesce(list('max{colon}' || cnt) filter (cls = 1), [])), ', ') || ']' as histogram_data from h {'group by ' + ', '.join(keys) if keys else ''}),
 q as (select *, {sel} from o) select {g}{val}, histogram_data from q"""


_PCT = [("p0", 0.0), ("p50", 50.0), ("p75", 75.0), ("p95", 95.0), ("p99_9", 99.9), ("p100", 100.0)]
_H = "p0,p50,p75,p95,p99.9,p100"
_cols = [n for n, _ in _PCT] + ["histogram_data"]
_add("request_percentiles", _conf("request", "~script", f"hv=0:500:5000,{_H}"), f"with {REQ}, {hist_sql('select script, t v, 1 w from req', ['script'], 0, 100000, 5000, _PCT, 'hv=0:500:5000')}", columns=["script", *_cols])
_add("request_percentiles_narrow", _conf("request", "~host,+app", f"hv=0:200:100,{_H}"), f"with {REQ}, {hist_sql('select host, app, t v, 1 w from req where app is not null', ['host', 'app'], 0, 2000000, 100, _PCT, 'hv=0:200:100')}", columns=["host", "app", *_cols])
_add("timer_percentiles_weighted", _conf("timer", "@flag,@state", f"hv=0:1000:100000,{_H}"), f"with {TIM}, {hist_sql('select flag, state, t // hit v, hit w from tim where flag is not null and state is not null and request_id in (select o_orderkey from orders)', ['flag', 'state'], 0, 10000, 100000, _PCT, 'hv=0:1000:100000')}", _flat, columns=["flag", "state", *_cols])
_add("packet_percentiles", _conf("packet", "no_keys", f"hv=0:500:5000,{_H}"), f"with {REQ}, {hist_sql('select t v, 1 w from req', [], 0, 100000, 5000, _PCT, 'hv=0:500:5000', True)}", columns=_cols)

# --- windows ----------------------------------------------------------------------------------

_DAYS = _conf("request", "~script", window=f"{86400 * 30},{86400}")
_AS_OF = "1998-09-02 07:00:00"
_TICKED = "select script, epoch(ts)::bigint // 86400 * 86400 as tick, t, u, s, traffic, mem from req"
QUERIES["window_ticks"] = lambda spark, d: tick_table(from_orders(spark, d), _DAYS)
ORACLES["window_ticks"] = f"with {REQ} select tick, script, count(*) req, sum(t)::bigint as time, sum(u)::bigint utime, sum(s)::bigint stime, sum(traffic)::bigint traffic, sum(mem)::bigint mem from ({_TICKED}) group by tick, script"
_add("window_last_n_ticks", _DAYS, derived_sql("request", "select request_id, script, t, u, s, traffic, mem from req where ts < date '1998-09-02' and ts >= date '1998-09-02' - interval 30 day", ["script"], 86400 * 30, ctes=REQ), as_of=_AS_OF)
QUERIES["tick_merge_equivalence"] = lambda spark, d: merged(last_ticks(tick_table(from_orders(spark, d), _DAYS), _DAYS, 904719600), _DAYS)
ORACLES["tick_merge_equivalence"] = ORACLES["window_last_n_ticks"]
_TDAYS = parse_report_conf(f"v2/timer/{86400 * 30},{86400}/@flag/hv=0:1000:100000,p50,p99/no_filters")
QUERIES["tick_merge_timer_percentiles"] = lambda spark, d: merged(
    last_ticks(tick_table(from_orders(spark, d, flat=True), _TDAYS), _TDAYS, 904719600), _TDAYS, last_ticks(tick_histograms(from_orders(spark, d, flat=True), _TDAYS), _TDAYS, 904719600)
).select("flag", "req_count", "hit_count", "p50", "p99", "histogram_data")
_in = "ts < date '1998-09-02' and ts >= date '1998-09-02' - interval 30 day"
ORACLES["tick_merge_timer_percentiles"] = f"""with {REQ}, {TIM}, hh as (with {hist_sql(f'select flag, tim.t // hit v, hit w from tim join req using (request_id) where {_in}', ['flag'], 0, 10000, 100000, [('p50', 50.0), ('p99', 99.0)], 'hv=0:1000:100000')})
 select flag, req_count, hit_count, p50, p99, histogram_data from (select flag, count(distinct request_id) req_count, sum(hit)::bigint hit_count from req join tim using (request_id) where {_in} group by flag) join hh using (flag)"""
QUERIES["events_by_type"] = lambda spark, d: report(from_events(spark, d), _conf("request", "~script,+k"))
ORACLES["events_by_type"] = derived_sql("request", "select event_type script, json_extract_string(props, '$.k') k, round(coalesce(value, 0) * 1e6)::bigint t, 0 u, 0 s, 1 traffic, 0 mem from events where json_extract_string(props, '$.k') is not null", ["script", "k"], WINDOW, ctes="none_ as (select 1)")

# --- metrics tables ---------------------------------------------------------------------------

_MREQ = """mreq as (select distinct request_id, ts, coalesce(hostname, '') host, coalesce(server_name, '') server, coalesce(script_name, '') script, coalesce(document_size, 0) traffic, coalesce(memory_footprint, 0) mem,
 request_time x, ru_utime y, ru_stime z from requests)"""
_ns = lambda c: f"case when {c} is null or isnan({c}) or isinf({c}) then 0 else trunc(greatest({c}::double, 0.0) * 1e9)::bigint end"
_add("metrics_by_script", _conf("request", "~script"), derived_sql("request", f"select request_id, script, {_ns('x')} t, {_ns('y')} u, {_ns('z')} s, traffic, mem from mreq", ["script"], WINDOW, ctes=_MREQ), from_metrics)
_MTIM = f"""mtim as (select request_id, hit_count hit, trunc(timer_value::double * 1e9)::bigint t, {_ns('timer_ru_utime')} u, {_ns('timer_ru_stime')} s, list_filter(tags, lambda g: g.name = 'layer')[1].value as layer
 from (select distinct on (request_id, timer_no) * from timers) where timer_value >= 0 and not isnan(timer_value) and not isinf(timer_value) and hit_count > 0)"""
_add("metrics_by_layer", _conf("timer", "@layer"), derived_sql("timer", "select request_id, layer, hit, t, u, s from mreq join mtim using (request_id) where layer is not null", ["layer"], WINDOW, ctes=f"{_MREQ}, {_MTIM}"), from_metrics)

# --- counters ---------------------------------------------------------------------------------

_CR = _conf("request", "~host,+app", filters="min_time=0.1,+prio=1")
QUERIES["active_counters_timer_nested"] = lambda spark, d: counters(from_orders(spark, d), _CT)
QUERIES["active_counters_request"] = lambda spark, d: counters(from_orders(spark, d, flat=True), _CR)
ORACLES["active_counters_request"] = f"""with {REQ}, r as (select case when not (t >= 100000000 and coalesce(prio = '1', false)) then 'filters' when app is null then 'rtag' end reason from req)
 select count(*) packets_received, count(*) filter (reason is null) packets_aggregated, 0::bigint packets_dropped_by_bloom, count(*) filter (reason = 'filters') packets_dropped_by_filters, 0::bigint packets_dropped_by_rfield, count(*) filter (reason = 'rtag') packets_dropped_by_rtag, 0::bigint packets_dropped_by_timertag,
 0::bigint timers_scanned, 0::bigint timers_aggregated, 0::bigint timers_skipped_by_bloom, 0::bigint timers_skipped_by_filters, 0::bigint timers_skipped_by_tags from r"""
_CT = _conf("timer", "~server,+app,@state", filters="@flag=R,~status=200")
QUERIES["active_counters_timer"] = lambda spark, d: counters(from_orders(spark, d, flat=True), _CT)
ORACLES["active_counters_timer"] = f"""with {REQ}, {TIM},
 p as (select req.request_id, any_value(status) status, any_value(app) app, any_value(server) server, count(tim.request_id) n, count(*) filter (state is not null) > 0 and count(flag) > 0 as names_ok,
  count(tim.request_id) filter (state is null) b, count(*) filter (state is not null and (flag <> 'R' or mixed)) f, count(*) filter (state is not null and flag = 'R' and not mixed) k from req left join tim using (request_id) group by req.request_id),
 e as (select *, case when not names_ok then 'bloom' when status <> '200' then 'filters' when app is null then 'rtag' when server = '' then 'rfield' end early from p)
 select count(*) packets_received, count(*) filter (early is null and k > 0) packets_aggregated, count(*) filter (early = 'bloom') packets_dropped_by_bloom, count(*) filter (early = 'filters') packets_dropped_by_filters, count(*) filter (early = 'rfield') packets_dropped_by_rfield,
  count(*) filter (early = 'rtag') packets_dropped_by_rtag, count(*) filter (early is null and k = 0) packets_dropped_by_timertag, coalesce(sum(n) filter (early is null), 0)::bigint timers_scanned, coalesce(sum(k) filter (early is null), 0)::bigint timers_aggregated,
  coalesce(sum(b) filter (early is null), 0)::bigint timers_skipped_by_bloom, coalesce(sum(f) filter (early is null), 0)::bigint timers_skipped_by_filters, 0::bigint timers_skipped_by_tags from e"""
ORACLES["active_counters_timer_nested"] = ORACLES["active_counters_timer"]
QUERIES["status_unpivot"] = lambda spark, d: counters(from_orders(spark, d, flat=True), _CR).select(*[F.col(n).cast("bigint").alias(n) for n in NAMES]).unpivot([], list(NAMES), "Variable_name", "Value")
ORACLES["status_unpivot"] = f"unpivot ({ORACLES['active_counters_request']}) on columns(*) into name Variable_name value Value"

# --- host SQL over report views ---------------------------------------------------------------


def _by_script(spark: SparkSession, d: str) -> DataFrame:
    return report(from_orders(spark, d, flat=True), _conf("request", "~host,~script"), columns=["host", "script", "req_count", "req_percent", "traffic_total"])


_VIEW = f"view_ as ({derived_sql('request', 'select request_id, host, script, t, u, s, traffic, mem from req', ['host', 'script'], WINDOW, ctes=REQ)})"
_OTHER = ["host-1", "host-2", "host-3"]


def _host(name: str, build: Callable[[DataFrame, SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: build(_by_script(spark, d), spark, d)
    ORACLES[name] = f"with {_VIEW} {sql}"


_host("report_where_having", lambda v, s, d: v.where(F.col("host") != "host-0").groupBy("script").agg(F.sum("req_count").alias("n")).where(F.col("n") > 100), "select script, sum(req_count)::bigint n from view_ where host <> 'host-0' group by script having sum(req_count) > 100")
_host("report_topk", lambda v, s, d: v.orderBy(F.desc("traffic_total"), "host", "script").limit(10).select("host", "script", "traffic_total"), "select host, script, traffic_total from view_ order by traffic_total desc, host, script limit 10")
for _how, _sql in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("full", "full join")):
    _host(
        f"report_join_{_how}",
        lambda v, s, d, how=_how: v.where("script = 'script-1' or script = 'script-2'").select("host", "script", "req_count").join(v.where("script = 'script-2' or script = 'script-3'").groupBy("script").agg(F.max("req_count").alias("most")), "script", how).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("req_count", "most")}),
        f"select coalesce(a.script, b.script) script, host, coalesce(req_count, -1) req_count, coalesce(most, -1) most from (select host, script, req_count from view_ where script in ('script-1', 'script-2')) a {_sql} (select script, max(req_count) most from view_ where script in ('script-2', 'script-3') group by script) b on a.script = b.script",
    )
_host("report_join_semi", lambda v, s, d: v.select("host", "script").join(v.where("req_percent > 0.55").select("script").distinct(), "script", "left_semi"), "select host, script from view_ where script in (select script from view_ where req_percent > 0.55)")
_host("report_join_anti", lambda v, s, d: v.select("host", "script").join(v.where("req_percent > 0.55").select("script").distinct(), "script", "left_anti"), "select host, script from view_ where script not in (select script from view_ where req_percent > 0.55)")
_host("report_range_join", lambda v, s, d: _ranges(v, s), "select host, script, band from view_ join (values ('low', 0, 70), ('mid', 70, 80), ('high', 80, 100000)) b(band, lo, hi) on req_count >= lo and req_count < hi")
_host("report_union", lambda v, s, d: v.where("host = 'host-1'").select("script").unionByName(v.where("host = 'host-2'").select("script")), "select script from view_ where host = 'host-1' union all select script from view_ where host = 'host-2'")
_host("report_intersect", lambda v, s, d: v.where("req_count > 70 and host = 'host-1'").select("script").intersect(v.where("req_count > 70 and host = 'host-2'").select("script")), "select script from view_ where req_count > 70 and host = 'host-1' intersect select script from view_ where req_count > 70 and host = 'host-2'")
_host("report_except", lambda v, s, d: v.where("host = 'host-1'").select("script").subtract(v.where("req_count > 70 and host = 'host-2'").select("script")), "select script from view_ where host = 'host-1' except select script from view_ where req_count > 70 and host = 'host-2'")
_host("report_distinct", lambda v, s, d: v.select("host").distinct(), "select distinct host from view_")
_host("report_rank_window", lambda v, s, d: v.select("host", "script", F.rank().over(Window.partitionBy("host").orderBy(F.desc("req_count"))).cast("bigint").alias("rnk"), F.lag("req_count", 1, -1).over(Window.partitionBy("host").orderBy("script")).alias("before")), "select host, script, rank() over (partition by host order by req_count desc) rnk, lag(req_count, 1, -1) over (partition by host order by script) before from view_")
_host("report_rollup", lambda v, s, d: v.rollup("host", "script").agg(F.sum("req_count").alias("n")), "select host, script, sum(req_count)::bigint n from view_ group by rollup (host, script)")
_host("report_cube", lambda v, s, d: v.cube("host", "script").agg(F.sum("req_count").alias("n"), F.grouping_id().cast("bigint").alias("gid")), "select host, script, sum(req_count)::bigint n, grouping_id(host, script)::bigint gid from view_ group by cube (host, script)")
_host("report_scalar_subquery", lambda v, s, d: _subquery(v, s), "select host, script, req_count - (select min(req_count) from view_) above_least from view_ where req_count > (select avg(req_count) from view_)")
_host("report_percent_after_where", lambda v, s, d: v.where("host = 'host-4'").select("script", "req_percent"), "select script, req_percent from view_ where host = 'host-4'")
_host("report_like", lambda v, s, d: v.where(F.col("script").like("script-1%")).select("host", "script", F.upper("host").alias("shout"), F.length("script").cast("bigint").alias("len")), "select host, script, upper(host) shout, length(script) len from view_ where script like 'script-1%'")


def _ranges(v: DataFrame, spark: SparkSession) -> DataFrame:
    bands = spark.createDataFrame([("low", 0, 70), ("mid", 70, 80), ("high", 80, 100000)], "band string, lo int, hi int")
    return v.join(F.broadcast(bands), (F.col("req_count") >= F.col("lo")) & (F.col("req_count") < F.col("hi"))).select("host", "script", "band")


def _subquery(v: DataFrame, spark: SparkSession) -> DataFrame:
    v.createOrReplaceTempView("ticktally_view")
    return spark.sql("select host, script, req_count - (select min(req_count) from ticktally_view) above_least from ticktally_view where req_count > (select avg(req_count) from ticktally_view)")
