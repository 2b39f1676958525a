from datetime import datetime, timedelta, timezone

import pytest
from golden import nested

from ticktally.operators.counters import NAMES
from ticktally.operators.report import report
from ticktally.operators.source import SCHEMA, Source
from ticktally.operators.ticks import merged, tick_table
from ticktally.plans.conf import TEMPLATES, ConfError, parse_report_conf
from ticktally.plans.engine import ACTIVE, STATS, Engine, EngineConfig
from ticktally.streaming.ticks import fan_out, report_of, stream_ticks, write_ticks


def test_registry(spark):
    e = Engine(spark, nested(spark))
    e.create_report("by_script", "v2/request/default_history_time/~script/no_percentiles/no_filters")
    e.create_report("by_group", "v2/timer/60/@group/no_percentiles/no_filters")
    assert spark.sql("select req_count from by_script where script = 'a.php'").first()[0] == 3
    assert spark.sql("select s.script, g.`group` from by_script s cross join by_group g order by 1, 2 limit 1").first()[0] == "a.php"
    for name, text in (("by_script", TEMPLATES["info"]), ("bad", "v2/x"), ("a b", TEMPLATES["info"])):
        with pytest.raises(ConfError):
            e.create_report(name, text)
    e.rename_report("by_script", "scripts")
    r = next(r for r in e.reports() if r.name == "scripts")
    assert r.internal == "by_script" and spark.table("scripts").count() == 2
    s = e.snapshot("scripts")
    assert s.count() == 2 and r.active_since
    s.unpersist()
    a = {x.table_name: x for x in e.active().collect()}
    assert e.active().columns == [c.split()[0] for c in ACTIVE] and len(ACTIVE) == 29
    assert a["by_group"].timers_aggregated == 7 and a["scripts"].packets_aggregated == 6
    assert len(STATS) == 37 and e.stats().count() == 1 and e.status().count() == 38
    assert e.status().where("Variable_name like '%control_requests'").first().Value == "2"
    e.create_report("active", "v2/active")
    assert spark.table("active").count() == 2
    e.create_report("third", "v2/request/60/~host/no_percentiles/no_filters")
    assert spark.table("active").count() == 3  # system tables follow the registry
    e.drop_report("third")
    assert spark.table("active").count() == 2
    for name in ("scripts", "by_group"):
        assert e.active().where(f"table_name = '{name}'").select(*NAMES).first() == e.state(name).select(*NAMES).first()
    e.drop_report("scripts")
    with pytest.raises(ConfError):
        e.dataframe("scripts")
    for refused in (e.alter_report, e.insert):
        with pytest.raises(ConfError):
            refused("by_group")
    assert e.debug_packets(1.0).count() == 6
    assert e.table_info("by_group")["columns"][0] == "group" and e.table_info("by_group")["records"] == 2
    assert all('"group"' in r.line for r in e.dump("by_group").collect()) and e.active().first().approx_mem_used > 0
    assert e.listen().columns == ["packet_no", "received_us", "datagram"]


def test_config():
    with pytest.raises(ConfError):
        EngineConfig(default_history_time_sec=5)
    assert len(EngineConfig().variables()) >= 13


def _requests():
    t0 = datetime(2030, 1, 1, tzinfo=timezone.utc)
    return [(i, t0 + timedelta(seconds=i), f"h{i % 3}", "s", f"x{i % 2}", "", "200", i, 0, i * 1000, 0, 0, [("app", "y")], [(1, i * 10, 0, 0, [("group", f"g{i % 2}")]), (2, i, 0, 0, [("group", "g0")])]) for i in range(200)]


@pytest.mark.parametrize("text", ["v2/request/60,10/~script/no_percentiles/no_filters", "v2/timer/60,10/@group/no_percentiles/no_filters"])
def test_stream_equals_batch_on_closed_ticks(spark, tmp_path, text):
    conf = parse_report_conf(text)
    batch = spark.createDataFrame(_requests(), SCHEMA)
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = write_ticks(stream_ticks(Source(live), conf), str(tmp_path / "ticks"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "ticks")).drop("day").collect()}
    want = {tuple(r) for r in tick_table(Source(batch), conf).collect()}
    last = max(t for t, *_ in want)
    assert got == {r for r in want if r[0] < last}
    end = 1893456000 + 180
    a = report_of(spark, str(tmp_path / "ticks"), conf, end).collect()
    b = merged(tick_table(Source(batch), conf).where(f"tick >= {end - 60} and tick < {end}"), conf).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) != []


def test_views_hold_their_window(spark):
    """Requests at seconds 0 to 199; a window of 60 seconds in ticks of 10."""
    e = Engine(spark, Source(spark.createDataFrame(_requests(), SCHEMA)))
    e.create_report("windowed", "v2/request/60,10/~script/no_percentiles/no_filters")
    got = {r.script: (r.req_count, r.req_per_sec) for r in spark.table("windowed").collect()}
    assert got == {"x0": (30, 0.5), "x1": (30, 0.5)}  # seconds 140 to 199
    at = e.dataframe("windowed", as_of="2030-01-01 00:01:05").collect()
    assert sum(r.req_count for r in at) == 60
    assert Engine(spark, e.source, clock="now").create_report("stale", "v2/request/60/~script/no_percentiles/no_filters") and spark.table("stale").count() == 0


@pytest.mark.parametrize("text", ["v2/request/60,10/~script/hv=0:1000:1000,p50,p99/no_filters", "v2/timer/60,10/@group/hv=0:1000:100000,p50,p99/no_filters"])
def test_live_percentiles(spark, tmp_path, text):
    """Percentiles and histograms of a report that a stream feeds equal those of the batch over the same ticks."""
    batch = spark.createDataFrame(_requests(), SCHEMA)
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    e = Engine(spark, Source(batch))
    e.create_report("live_one", text)
    live = Source(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    assert e.feed("live_one", live, str(tmp_path / "live")).query.awaitTermination(120)
    e.refresh("live_one")
    got = sorted(map(tuple, spark.table("live_one").collect()))
    want = sorted(map(tuple, report(Source(batch), parse_report_conf(text), as_of="2030-01-01 00:03:10").collect()))  # the last slice is open
    assert got == want != []
    assert e.active().first().approx_row_count == 2
    e.drop_report("live_one")
    with pytest.raises(ConfError):
        e.dataframe("live_one")


def test_fan_out(spark, tmp_path):
    """Two reports from one stream; a batch that is repeated counts once."""
    batch = spark.createDataFrame(_requests(), SCHEMA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    confs = {"a": parse_report_conf("v2/request/60,10/~host/no_percentiles/no_filters"), "b": parse_report_conf("v2/timer/60,10/@group/hv=0:1000:1000,p50/no_filters")}
    live = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for again in range(2):  # with a new checkpoint all batches come again under the same numbers
        fan_out(live, confs, str(tmp_path / "out"), str(tmp_path / f"cp{again}")).awaitTermination(120)
    for name, conf in confs.items():
        got = sorted(map(tuple, report_of(spark, str(tmp_path / "out" / name), conf, "2030-01-01 00:02:00").collect()))
        assert got == sorted(map(tuple, report(Source(batch), conf, as_of="2030-01-01 00:02:00").collect())) != []


@pytest.mark.parametrize("readers", [1, 3])
def test_udp_stream_end_to_end(spark, tmp_path, readers):
    """Datagrams through the stream source, decoding, validation and a report."""
    import socket
    import time

    from pyspark.sql import functions as F

    from ticktally.operators.report import report
    from ticktally.sources import udp, wire

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    udp.register(spark)
    got = []
    live = spark.readStream.format("udp_metrics").option("address", "127.0.0.1").option("port", port).option("readers", readers).option("batch_timeout_ms", 300).load()
    q = live.writeStream.foreachBatch(lambda df, n: got.extend(bytes(r.datagram) for r in df.collect())).option("checkpointLocation", str(tmp_path / "udp")).start()
    try:
        message = {"hostname": "h", "server_name": "s", "script_name": "x", "request_count": 1, "document_size": 7, "memory_peak": 1, "request_time": 0.5, "ru_utime": 0.0, "ru_stime": 0.0}
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            until = time.time() + 60
            while len(got) < 3 and time.time() < until:
                s.sendto(wire.encode_message(message), ("127.0.0.1", port))
                time.sleep(0.2)
    finally:
        q.stop()
    assert len(got) >= 3
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(got)], "n bigint, datagram binary")
    source = wire.ingest(wire.decode(rows, "datagram", ["n"]).withColumn("ts", F.current_timestamp()), "n", "ts")
    assert report(source, parse_report_conf("v2/request/60/~host/no_percentiles/no_filters")).first().traffic_total == 7 * len(got)
