import pytest

from ticktally.plans.conf import LEGACY_REPORTS, ConfError, Key, legacy_report_conf, make_histogram, parse_report_conf


@pytest.mark.parametrize("text, kind, keys", [
    ("v2/packet/default_history_time/no_keys/no_percentiles/no_filters", "packet", 0),
    ("v2/info/60/no_keys/no_percentiles/no_filters", "packet", 0),
    ("v2/request/60/~script/no_percentiles/no_filters", "request", 1),
    ("v2/timer/60/@a,@b,c/hv=0:1000:100000,p50,p75,p95,p99,p100/+phase=call,+cluster=w.m", "timer", 3),
    ("v2/timer/60/~host,~script,~server,@tag10/no_percentiles/no_filters", "timer", 4),
    ("v2/active", "active", 0), ("v2/stats", "stats", 0),
])
def test_accepted(text, kind, keys):
    c = parse_report_conf(text)
    assert c.kind == kind and len(c.keys) == keys


def test_parts():
    c = parse_report_conf("v2/timer/120,10/~host,+app,bare/hv=0:2000:20000,p99,percentiles=99.9:100/min_time=0.5,max_time=2,~status=200,@op=get,+a=b")
    assert (c.window_sec, c.tick_sec, c.tick_count) == (120, 10, 12)
    assert c.keys == (Key("field", "host"), Key("rtag", "app"), Key("ttag", "bare"))
    assert c.percentiles == (("p99", 99.0), ("p99_9", 99.9), ("p100", 100.0))
    assert c.bound_ns("min") == 500_000_000 and c.bound_ns("min", "ms") == 500_000
    assert [k.kind for k, _ in c.filters] == ["field", "ttag", "rtag"]
    assert parse_report_conf("v2/timer/60/~host/no_percentiles/no_filters").warnings


@pytest.mark.parametrize("text", [
    "v1/packet/60/no_keys/no_percentiles/no_filters", "v2/nothing/60/no_keys/no_percentiles/no_filters", "v2/request/60/~host/no_percentiles", "v2/packet/60/~host/no_percentiles/no_filters",
    "v2/request/60/" + ",".join(["~host"] * 16) + "/no_percentiles/no_filters", "v2/request/x/~host/no_percentiles/no_filters", "v2/request/0/~host/no_percentiles/no_filters", "v2/request/60,7/~host/no_percentiles/no_filters",
    "v2/request/60,0/~host/no_percentiles/no_filters", "v2/request/60/~host/hv=0:1,p50/no_filters", "v2/request/60/~host/hv=5:5:10,p50/no_filters", "v2/request/60/~host/hv=0:10:0,p50/no_filters", "v2/request/60/~host/p50/no_filters",
    "v2/request/60/~host/hv=0:1000:200000000,p50/no_filters", "v2/request/60/~host/hv=0:10:10/no_filters", "v2/request/60/~host/hv=0:10:10,x/no_filters", "v2/request/60/~host/no_percentiles/a=b=c", "v2/request/60/~nofield/no_percentiles/no_filters",
    "v2/request/60/@tag/no_percentiles/no_filters", "v2/packet/60/no_keys/no_percentiles/@t=1", "v2/request/60/~host/no_percentiles/@t=1", "v2/request/60/~host/no_percentiles/min_time=-1", "v2/request/60/~host/no_percentiles/min_time=3,max_time=2",
    "v2/request/60/no_keys/no_percentiles/no_filters", "v2/request/60/~host/hv=150:200:100,p50/no_filters", "v2/active/60",
])
def test_refused(text):
    with pytest.raises(ConfError):
        parse_report_conf(text)


def test_histogram_width():
    h = make_histogram(0, 60000, 32768)
    assert h.width_ns == 1_831_054 and h.high_ns == 59_999_977_472 and h.text() == "hv=0:59999:32768"


def test_legacy():
    for name, fields in LEGACY_REPORTS.items():
        c = parse_report_conf(legacy_report_conf(f"{name}::"))
        assert c.kind == "request" and tuple(k.name for k in c.keys) == fields and c.percentiles[0][0] == "p50"
    c = parse_report_conf(legacy_report_conf("tagN_report2:a,b:min_time=0.1,histogram_max_time=2:95,99"))
    assert [k.name for k in c.keys] == ["script", "host", "server", "a", "b"] and c.min_time == 0.1
    assert [p for p, _ in c.percentiles] == ["p50", "p95", "p99"] and c.histogram.high_ns <= 2_000_000_000
    assert parse_report_conf(legacy_report_conf("rtag2_report:a,b")).keys[0] == Key("field", "host")
    assert "~x=+a" in legacy_report_conf("report1::~x=tag.a") and legacy_report_conf("tag") is None
    with pytest.raises(ConfError):
        legacy_report_conf("report19::")
