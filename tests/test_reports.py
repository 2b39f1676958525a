from datetime import datetime, timezone

import pytest
from golden import flat, nested
from pyspark.sql import functions as F

from ticktally.functions.hist import bucket
from ticktally.operators.counters import counters
from ticktally.operators.report import report
from ticktally.operators.source import SCHEMA, Source
from ticktally.operators.ticks import last_ticks, merged, tick_histograms, tick_table
from ticktally.plans.conf import Histogram, make_histogram, parse_report_conf


def conf(kind, keys="no_keys", hist="no_percentiles", filters="no_filters", window=60):
    return parse_report_conf(f"v2/{kind}/{window}/{keys}/{hist}/{filters}")


@pytest.mark.parametrize("filters, want", [
    ("no_filters", (6, 8, 2.559, 660, 4600)), ("min_time=0.01,max_time=1", (4, 7, 1.059, 360, 2600)), ("+app=x", (3, 6, 0.060, 350, 2500)), ("+app=y", (1, 1, 1.5, 300, 2000)), ("~host=none", (0, 0, 0.0, 0, 0)),
])
@pytest.mark.parametrize("make", [nested, flat])
def test_packet(spark, make, filters, want):
    (r,) = report(make(spark), conf("packet", filters=filters)).collect()
    assert (r.req_count, r.timer_count, pytest.approx(r.time_total), r.traffic, r.memory_footprint) == want


@pytest.mark.parametrize("keys, want", [
    ("~script", {("a.php",): (3, 1.029, 310, 2100), ("b.php",): (3, 1.53, 350, 2500)}),
    ("~server", {("",): (1, 1.5, 300, 2000), ("s1",): (4, 1.059, 360, 2600), ("s2",): (1, 0, 0, 0)}),
    ("~host,+app", {("h1", "x"): (3, 0.06, 350, 2500), ("h2", "y"): (1, 1.5, 300, 2000), ("h3", ""): (1, 0.999, 10, 100)}),
    ("~status", {("0",): (1, 0, 0, 0), ("200",): (3, 0.06, 350, 2500), ("404",): (1, 0.999, 10, 100), ("500",): (1, 1.5, 300, 2000)}),
])
def test_request(spark, keys, want):
    df = report(nested(spark), conf("request", keys))
    n = len(keys.split(","))
    got = {tuple(r[:n]): (r.req_count, pytest.approx(r.req_time_total), r.traffic_total, r.memory_footprint) for r in df.collect()}
    assert got == want
    assert len(df.columns) == n + 18


TIMERS = {
    ("@group", "no_filters"): {("db",): (4, 12, 40, 3, 1), ("mc",): (1, 1, 3, 0, 0)},
    ("@group,@op", "no_filters"): {("db", "get"): (3, 7, 24, 1, 0), ("db", "set"): (2, 5, 16, 2, 1)},
    ("~server,@group", "no_filters"): {("s1", "db"): (4, 12, 40, 3, 1)},
    ("@op,~host,+app", "no_filters"): {("get", "h1", "x"): (3, 8, 26, 1, 0), ("set", "h1", "x"): (1, 2, 6, 0, 0), ("set", "h3", ""): (1, 3, 10, 2, 1)},
    ("@op", "@group=db"): {("get",): (2, 3, 16, 1, 0), ("set",): (2, 5, 16, 2, 1)},
    ("~script", "no_filters"): {("a.php",): (3, 8, 32, 3, 1), ("b.php",): (2, 6, 13, 0, 0)},
    ("@group", "+app=x"): {("db",): (3, 9, 30, 1, 0)},
}


@pytest.mark.parametrize("case", TIMERS, ids=str)
@pytest.mark.parametrize("make", [nested, flat])
def test_timer(spark, make, case):
    keys, filters = case
    df = report(make(spark), conf("timer", keys, filters=filters))
    n = len(keys.split(","))
    got = {tuple(r[:n]): (r.req_count, r.hit_count, round(r.time_total * 1000), round(r.ru_utime_total * 1000), round(r.ru_stime_total * 1000)) for r in df.collect()}
    assert got == TIMERS[case]
    assert len(df.columns) == n + 15


COUNTERS = [
    ("request", "~script", "no_filters", (6, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)), ("request", "~host,+app", "no_filters", (6, 5, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("timer", "@group", "no_filters", (6, 5, 1, 0, 0, 0, 0, 8, 7, 1, 0, 0)), ("timer", "@group,@op", "no_filters", (6, 4, 2, 0, 0, 0, 0, 7, 6, 1, 0, 0)), ("timer", "~server,@group", "no_filters", (6, 4, 1, 0, 1, 0, 0, 7, 6, 1, 0, 0)),
    ("timer", "@op,~host,+app", "no_filters", (6, 4, 2, 0, 0, 0, 0, 7, 7, 0, 0, 0)), ("timer", "@op", "@group=db", (6, 3, 2, 0, 0, 0, 1, 7, 5, 1, 1, 0)), ("timer", "~script", "no_filters", (6, 5, 0, 0, 0, 0, 1, 8, 8, 0, 0, 0)),
    ("timer", "@group", "+app=x", (6, 3, 1, 2, 0, 0, 0, 6, 5, 1, 0, 0)),
]


@pytest.mark.parametrize("kind, keys, filters, want", COUNTERS)
def test_counters(spark, kind, keys, filters, want):
    for make in (nested, flat):
        (r,) = counters(make(spark), conf(kind, keys, filters=filters)).collect()
        assert tuple(r) == want


def test_percents_are_of_all_rows_even_below_a_filter(spark):
    df = report(nested(spark), conf("timer", "@group"))
    assert {r.group: r.req_percent for r in df.collect()} == {"db": 80.0, "mc": 20.0}
    assert df.where("group = 'mc'").first().req_percent == 20.0
    zero = report(nested(spark), conf("request", "~host", filters="~status=0")).first()
    assert zero.req_percent == 100.0 and zero.traffic_percent is None and zero.req_per_sec == pytest.approx(1 / 60)


def test_percentiles(spark):
    got = {r.script: r for r in report(nested(spark), conf("request", "~script", "hv=0:1000:1000,p0,p50,p99,p100")).collect()}
    a, b = got["a.php"], got["b.php"]
    assert (a.p0, a.p50, a.p99, a.p100) == (0, 0.02, 0.996, 0.996) and (b.p0, b.p50, b.p99, b.p100) == (0, 0.03, 1.0, 1.0)
    assert a.histogram_data == "hv=0:1000:1000;values=[10:1, 20:1, 996:1]" and b.histogram_data == "hv=0:1000:1000;values=[30:1, min:1, max:1]"
    for make in (nested, flat):
        t = {r.group: r for r in report(make(spark), conf("timer", "@group", "hv=0:1000:1000,p50,p100")).collect()}
        assert (t["db"].p50, t["db"].p100, t["mc"].p50) == (0.003, 0.007, 0.003)
        assert t["db"].histogram_data == "hv=0:1000:1000;values=[2:4, 3:2, 4:4, 5:1, 7:1]"
    p = report(nested(spark), conf("packet", hist="hv=0:1000:1000,p50")).first()
    assert p.histogram_data == "hv=0:1000:1000;values=[10: 1, 20: 1, 30: 1, 996: 1, min: 1, max: 1]"


def _percentiles(spark, hv, values):
    rows = [(i, None, "h", "s", "x", "", "200", 0, 0, v, 0, 0, [], []) for i, v in enumerate(values)]
    return report(Source(spark.createDataFrame(rows, SCHEMA)), conf("request", "~host", f"hv={hv},p0,p10,p50,p67,p75,p95,p99,p100")).first()


def test_histogram_vectors(spark):
    r = _percentiles(spark, "0:2000:20000", [0] * 3 + [7_000_000] * 3 + [3_000_000_000] * 3)
    assert (r.p0, r.p10, r.p67, r.p99, r.p100) == (0, 0, 2.0, 2.0, 2.0) and r.p50 == pytest.approx(0.006966666)
    r = _percentiles(spark, "0:1000:100000", [x * 1_000_000 for x in (1, 2, 5, 10, 50, 100, 500)])
    assert (r.p50, r.p75, r.p95, r.p99, r.p100) == (0.01, 0.09984, 0.4992, 0.4992, 0.4992)
    assert r.histogram_data.endswith("[100:1, 200:1, 500:1, 1000:1, 4992:1, 9984:1, 49920:1]")
    assert _percentiles(spark, "0:1000:100000", [10_010_000]).p100 == 0.01
    assert "max:1" in _percentiles(spark, "0:1000:100000", [1_234_567_000]).histogram_data


def test_bucket_modes(spark):
    h = make_histogram(100, 200, 100)
    one = lambda ns, **kw: tuple(spark.range(1).select(bucket(F.lit(ns), h, **kw).alias("b")).first().b)
    assert one(150_000_000, compat="ref") == (0, 128) and one(100_000_000, compat="ref") == (0, 64)
    assert one(150_000_000) == (0, 50) and one(100_000_000)[0] == -1 and one(250_000_000)[0] == 1
    w = Histogram(0, 1, 100_000)
    for v, want in ((1, 1), (255, 255), (256, 256), (257, 256), (1001, 1000), (5000, 4992), (10000, 9984), (50000, 49920)):
        assert tuple(spark.range(1).select(bucket(F.lit(v), w).alias("b")).first().b) == (0, want)
        assert tuple(spark.range(1).select(bucket(F.lit(v), w, quantize=False).alias("b")).first().b) == (0, v)


def test_histogram_branch_is_planned_on_demand(spark):
    c = conf("request", "~script", "hv=0:1000:1000,p50")
    plan = lambda cols: report(nested(spark), c, columns=cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(["script", "p50"]) and "Window" not in plan(["script", "req_count"])


def test_ticks_merge_to_the_direct_report(spark):
    for make, kind, keys in ((nested, "request", "~script"), (flat, "timer", "@group"), (nested, "timer", "@group")):
        c = conf(kind, keys, "hv=0:1000:1000,p50,p100")
        s = make(spark)
        got = merged(last_ticks(tick_table(s, c), c, 1893456060), c, tick_histograms(s, c))
        want = report(s, c, as_of="2030-01-01 00:01:00")
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    assert report(nested(spark), conf("request", "~script"), as_of="2030-01-01 00:05:00").count() == 0


def test_empty_source(spark):
    s = Source(spark.createDataFrame([], SCHEMA))
    assert report(s, conf("packet")).first().req_count == 0
    assert report(s, conf("request", "~host", "hv=0:10:10,p50")).count() == 0
    assert report(s, conf("timer", "@a")).count() == 0
    assert counters(s, conf("timer", "@a")).first().packets_received == 0


@pytest.mark.parametrize("names, columns", [(("time", "hit", "traffic"), ("time_2", "hit_2", "traffic_2")), (("req_count", "Req_Count", "request_id"), ("req_count_2", "Req_Count_3", "request_id_2")), (("p50", "__kept", "cls"), ("p50_2", "kept_2", "cls_2")), (("t", "b", "k"), ("t", "b", "k"))])
def test_keys_named_like_columns(spark, names, columns):
    """Keys with the names of measures, of internal columns and of percentiles, in any case."""
    at = datetime(2030, 1, 1, tzinfo=timezone.utc)
    tags = [(n, f"v{i}") for i, n in enumerate(names)]
    rows = [(i, at, "h", "s", "x", "", "200", 1, 1, 1000 * i, 0, 0, tags, [(1, 10, 0, 0, tags), (2, 20, 0, 0, tags)]) for i in range(4)]
    source = Source(spark.createDataFrame(rows, SCHEMA))
    (r,) = report(source, conf("request", ",".join(f"+{n}" for n in names), "hv=0:1000:1000,p50")).collect()
    assert [r[c] for c in columns] == ["v0", "v1", "v2"] and r.req_count == 4
    for s in (source, Source(source.requests.drop("timers"), source.requests.select("request_id", F.explode("timers").alias("x")).select("request_id", "x.*"))):
        (r,) = report(s, conf("timer", ",".join(f"@{n}" for n in names), "hv=0:1000:1000,p50")).collect()
        assert [r[c] for c in columns] == ["v0", "v1", "v2"] and (r.req_count, r.hit_count) == (4, 12)
