"""Nested records, wide tables, spikes and hot keys: brute force and awkward input."""

import json
import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktally.operators import skew, spikes, wide
from ticktally.operators.asof import asof_join
from ticktally.operators.nested import Child, Element, graph_of, observed_edges, plan_relations, read_json, write_json
from ticktally.plans import problems
from ticktally.sources.wire_json import GRAPH, request_shredder

T0 = datetime(2031, 1, 1, tzinfo=timezone.utc)


def test_shared_inlining():
    plan = plan_relations(GRAPH, "envelope")
    assert plan["request"].reasons == ("repeated", "shared", "recursive") and plan["tag"].reasons == ("repeated", "shared")
    g = {e.name: e for e in (Element("a", (("x", "int"),), (Child("b", "b"), Child("c", "c", True))), Element("b", (("y", "int"),), (Child("d", "d"),)), Element("c", (("z", "int"),), (Child("d", "d"),)), Element("d", (("w", "int"),)))}
    plan = plan_relations(g, "a")
    assert set(plan) == {"a", "c", "d"} and plan["a"].columns == [("x", "int"), ("b_y", "int")] and plan["a"].inlined == [("b",)]
    assert sorted(plan["d"].under) == [("a", ("b", "d")), ("c", ("d",))]


def test_observed_graph(spark):
    """Singletons are inlined, repeated, shared and recursive elements get tables; types are joined over documents."""
    docs = [{"a": 1, "sub": {"b": "x", "deep": {"c": True}}, "items": [{"n": 1}, {"n": 2.5}], "tags": ["u"], "kids": {"0": {"a": 2, "kids": []}}}, {"a": "t", "other": {"deep": {"c": False}}, "kids": [{"kids": [{"a": 3}]}]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in docs] + [(None,), ("",), ("{cut",), ("7",)], "payload string")
    graph = graph_of([tuple(e)[:4] for e in observed_edges(df, "payload").collect()])
    plan = plan_relations(graph, "document")
    assert set(plan) == {"document", "deep", "items", "kids", "tags[]"} and plan["kids"].reasons == ("repeated", "shared", "recursive") and plan["deep"].reasons == ("shared",)
    assert ("record", "sub") in plan["document"].inlined and ("record_sub_b", "string") in plan["document"].columns and ("record_a", "string") in plan["document"].columns
    assert plan["items"].columns == [("n", "string")] and observed_edges(df.limit(0), "payload").count() == 0


LEAF = {"hostname": "h", "timer_hit_count": [2], "timer_value": [0.5], "timer_tag_count": [1], "timer_tag_name": [0], "timer_tag_value": [1]}
PAYLOADS = [
    (1, 0, json.dumps(LEAF | {"dictionary": ["a", "b"]})),
    (2, 0, json.dumps([{"hostname": "x"}, {"v": 1}])),
    (3, 0, json.dumps({"v": 1, "msg": {"scriptName": "s", "timerHitCount": "3", "timerValue": "0.1", "timerTagCount": {"0": 0}, "dictionary": ["q", "r"], "requests": {"0": json.dumps(LEAF), "1": LEAF | {"timer_tag_value": [7]}}}})),
    (4, 0, '{"hostname": "cut'), (4, 1, json.dumps(LEAF | {"dictionary": ["k", "v"]})), (4, 2, '{"hostname": "cut'),
    (5, 0, None), (6, 0, ""), (7, 0, "[]"), (8, 0, "null"), (9, 0, "12"),
]


def test_nested(spark, monkeypatch):
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), p, "path clash") for k, s, p in PAYLOADS], "packet_id bigint, received_at timestamp, payload string, path string")
    monkeypatch.setattr(problems, "table", lambda s, d, n: df)
    got = sorted(tuple(r) for r in problems.p1_found(spark, "").collect())
    none = (-1, -1, 0, "", "")
    assert got == sorted([
        (1, "0", "", 0, 0, 2, "a", "b"), (2, "0", "", *none), (2, "1", "", *none), (3, "0", "", 0, -1, 3, "", ""), (3, "0.0", "0", 0, 0, 2, "q", "r"), (3, "0.1", "0", *none), (4, "0", "", 0, 0, 2, "k", "v"),
    ])
    flat = request_shredder().flat(problems._shredded(spark, ""), "packet_id")
    assert flat["request"].count() == 7 and flat["request_timers"].count() == 4 and flat["request_timers_tags"].count() == 3
    monkeypatch.setattr(problems, "table", lambda s, d, n: df.limit(0))
    assert problems.p1_found(spark, "").count() == 0


def test_nested_to_any_depth():
    v = dict(LEAF, dictionary=["a", "b"])
    for _ in range(300):
        v = {"hostname": "o", "requests": [v]}
    rows = list(request_shredder().rows_of(json.dumps(v)))
    assert len(rows) == 301 and rows[-1][0].count(".") == 300 and rows[-1][2]["timers"][0]["tags"][0]["tag_name"] == "a"


def test_nested_beyond_the_stack():
    v = dict(LEAF, dictionary=["a", "b"])
    for _ in range(30_000):
        v = {"hostname": "o", "requests": [v]}
    n = 0
    for path, _, row in request_shredder().rows_of(write_json(v)):
        n += 1
    assert n == 30_001 and len(path) == 60_001 and row["timers"][0]["tags"][0]["tag_value"] == "b"
    text = "[" * 100_000 + '{"a": [1, 2.5, "x\\n", null, true, {}, []], "b": 12}' + "]" * 100_000
    assert write_json(read_json(text)) == text
    for broken in (text[:-1], text + "]", text.replace(" 12", ""), text.replace("null", "nul"), text.replace("}]", "},]")):
        assert read_json(broken) is None


def test_envelopes_and_numbers_without_bound():
    v = LEAF | {"dictionary": ["a", "b"]}
    for i in range(50):
        v = {"msg": v, "v": 1} if i % 9 else {"payload": json.dumps(v)} if i < 12 else {"body": v}
    (row,) = request_shredder().rows_of(json.dumps(v))
    assert row[2]["hostname"] == "h" and len(row[2]["timers"]) == 1
    (row,) = request_shredder().rows_of('{"hostname": "h", "status": ' + "9" * 5000 + ', "document_size": "' + "8" * 5000 + '", "memory_peak": "\u00b2"}')
    assert row[2]["hostname"] == "h" and row[2]["status"] is None and row[2]["document_size"] is None and row[2]["memory_peak"] is None


def test_whole_copies(spark, monkeypatch):
    deep = json.dumps(LEAF | {"dictionary": ["a", "b"]})
    for _ in range(600):
        deep = '{"hostname": "o", "requests": [' + deep + "]}"
    long = json.dumps({"hostname": "x" * 21_000_000})
    rows = [(1, 0, deep[:-3]), (1, 1, deep), (2, 0, long[:-1]), (2, 1, long), (3, 0, "{"), (3, 1, "[1"), *[(4, 5, json.dumps({"hostname": f"h{i}"})) for i in range(50)], (4, 3, '{"hostname": "first"}'), (None, 0, "{}")]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), p) for k, s, p in rows], "packet_id bigint, received_at timestamp, payload string")
    got = {r.packet_id: r.document for r in request_shredder().whole_copies(df, "packet_id", "payload", "received_at").collect()}
    assert set(got) == {1, 2, 4, None} and got[1] == deep and got[2] == long and got[4] == '{"hostname": "first"}'


VALUES = [
    ("int", "1,455", 1455), ("int", "31.00", 31), ("int", "88e3", 88000), ("int", "+50", 50), ("int", " 28\t", 28), ("int", "00000003", 3), ("int", "794_392", 794392), ("int", "-1", -1), ("int", "12a4", None), ("int", "2.5", None), ("int", "", None), ("int", "1,45", None), ("int", "NaN", None),
    ("float", "0,602", 602), ("float", "50961e-3", 50961), (("float"), ".383", 383), ("float", "41.3%", 413), ("float", "58.3 %", 583), ("float", "9393E-03", 9393), ("float", "-1.5", -1500), ("float", "null", None), ("float", "NaN", None),
    ("bool", " True", 1), ("bool", "off", 0), ("bool", "N", 0), ("bool", "2", None), ("bool", "", None),
    ("time", "2030-06-30T10:05:46Z", "2030-06-30 10:05:46"), ("time", "2030-09-27 17:23:06", "2030-09-27 17:23:06"), ("time", "1911490729", "2030-07-28 17:38:49"), ("time", "1901669690588", "2030-04-06 01:34:50"), ("time", "2030-05-12T18:06:47+09:00", "2030-05-12 09:06:47"),
    ("time", "2031-01-11T22:32:14.336Z", "2031-01-11 22:32:14"), ("time", "2030-10-04 23:11:36 UTC", "2030-10-04 23:11:36"), ("time", "2030-13-04 23:11:36", None), ("time", "soon", None), ("time", "12", None),
]


def test_typed_values(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(VALUES)], "i int, k string, t string")
    got = {r.i: r.v_num for r in wide.with_values(df, "k", "t").collect()}
    for i, (k, t, want) in enumerate(VALUES):
        if isinstance(want, str):
            assert got[i] is not None and datetime.fromtimestamp(got[i] // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") == want, (k, t)
        else:
            assert got[i] == want, (k, t, got[i])


def test_wide(spark):
    tags = [(1, 1, 0, 1), (1, 1, 0, 1), (1, 0, 2, 3), (1, 2, 0, 3), (2, 0, 0, 99), (2, 1, -1, 0), (3, 0, 0, 0), (None, 0, 0, 1), (4, 0, 4, 5), (4, 1, 0, 1)]
    dicts = [(1, ["Build No", "7", "x", "y"]), (1, ["Build No", "7", "x", "y"]), (2, ["build_no", "7"]), (4, ["build_no", "bad", "x", "y", "BUILD.NO", "9"])]
    t = spark.createDataFrame(tags, "request_id bigint, tag_no int, tag_name bigint, tag_value bigint").withColumn("attr", F.lit("clash"))
    d = spark.createDataFrame(dicts, "request_id bigint, dictionary array<string>").withColumn("kind", F.lit("clash"))
    c = spark.createDataFrame([("build_no", "int"), ("tenant", "string")], "tag string, value_type string")
    attributes = [("build_no", "int"), ("tenant", "string")]
    w = wide.stitch(wide.resolved_tags(t, d, c), "request_id", attributes, ["tag_no", "text"])
    assert sorted(tuple(r) for r in w.drop("ordinal").collect()) == [(1, 7, None), (2, None, None), (3, None, None), (4, 9, None)]
    assert sorted(r.ordinal for r in w.collect()) == [0, 1, 2, 3]
    assert wide.stitch(wide.resolved_tags(t.limit(0), d, c), "request_id", attributes, ["tag_no", "text"]).count() == 0


def test_stitch_in_small_blocks(spark):
    r = random.Random(3)
    cells = {(e, a): r.randint(0, 99) for e in r.sample(range(1000), 300) for a in r.sample(["a", "b", "c"], 2)}
    df = spark.createDataFrame([(e, a, None, v) for (e, a), v in cells.items()], "e bigint, attr string, v_text string, v_num bigint")
    rows = wide.stitch(df, "e", [("a", "int"), ("b", "int"), ("c", "int")], block=17).collect()
    assert {(x.e, a): x[a] for x in rows for a in "abc" if x[a] is not None} == cells
    assert sorted(x.ordinal for x in rows) == list(range(len({e for e, _ in cells}))) and len({x.e for x in rows}) == len(rows)
    twice = df.withColumn("n", F.lit(1)).unionByName(df.withColumn("n", F.lit(0)).withColumn("v_num", F.lit(None).cast("bigint")))
    rows = wide.stitch(twice, "e", [("a", "int"), ("b", "int"), ("c", "int")], ["n"], block=17).collect()
    assert len(rows) == len({e for e, _ in cells}) and all(x[a] is None for x in rows for a in "abc")  # the first decides, also when empty


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < 0.5 else None if r.random() < 0.1 else f"k{r.randint(0, 60)}", r.randint(0, 9)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, k string, n int")


def test_fragments(spark, hot):
    rows, df = hot
    plan = skew.plan_fragments(df, ["k"], tasks=8)
    assert max(plan.loads) < 1.4 * len(rows) / 8 and sum(plan.loads) >= len(rows) and any(k == ("hot",) and len(t) >= 4 for k, t in plan.heavy)
    got = skew.fragment_aggregate(df, ["k"], ["id"], [F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")], [F.sum("c").alias("c"), F.sum("s").alias("s")], plan)
    want = {}
    for _, k, n in rows:
        c, s = want.get(k, (0, 0))
        want[k] = (c + 1, s + n)
    assert {r.k: (r.c, r.s) for r in got.collect()} == want
    sizes = [r.c for r in skew.place(df, plan, ["id"]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert max(sizes) < 1.6 * len(rows) / 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fragment_join(spark, hot, how):
    rows, df = hot
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k string, n int")
    got = skew.fragment_join(df, small, ["k"], ["id"], how, skew.plan_fragments(df, ["k"], tasks=8))
    assert got.columns == ["k", "id", "n", "n_right"]
    want = sorted(map(str, df.join(small.withColumnRenamed("n", "n_right"), "k", how).select(*got.columns).collect()))
    assert sorted(map(str, got.collect())) == want
    assert skew.fragment_join(df.limit(0), small, ["k"], ["id"], how).count() == 0


def _stream(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, ts timestamp, hostname string, request_time float, ru_utime float, memory_footprint bigint").withColumn("source", F.lit("clash"))


def test_spikes(spark):
    r = random.Random(2)
    rows, want = [], set()
    for h in ("a", "b", "", None):
        for i in range(300):
            rows.append([len(rows), T0 + timedelta(minutes=7 * i), h, r.lognormvariate(-2, 0.5), None, int(r.uniform(2e7, 3e7)) // 4096 * 4096])
    a, b = range(0, 300), range(300, 600)
    for i, v in ((5, 40.0), (77, 200.0)):  # spikes of a source
        rows[i][3] = v
        want.add((i, "request_time"))
    rows[650][3] = 900.0  # no source: no spike
    for i, v in ((10, -1.0), (700, float("nan")), (1000, float("inf"))):
        rows[i][3] = v
        want.add((i, "request_time"))
    rows[20][4], rows[21][4], rows[5][4] = rows[20][3] + 1, rows[21][3] / 2, 50.0  # above its request; fine; above a case only
    want.add((20, "ru_utime"))
    for i in range(400, 409):  # stuck over a null and a change of day
        rows[i][3] = 0.125
        want.add((i, "request_time"))
    rows[404][3] = None
    want.discard((404, "request_time"))
    for i in range(500, 507):  # seven are not stuck
        rows[i][3] = 0.25
    for i in range(520, 540):
        rows[i][3] = 0.0
    rows[310][5] = 9_000_000  # below half of the lowest
    want.add((310, "memory_footprint"))
    for i in (320, 321):
        rows[i][5] = 4_294_967_295
        want.add((i, "memory_footprint"))
    few = [[2000 + i, T0 + timedelta(minutes=i), "few", 1.0, None, None] for i in range(19)]
    rows = [tuple(x) for x in rows + few]
    got = {tuple(x) for x in spikes.implausible(_stream(spark, rows + rows[400:420] + rows[:30])).collect()}
    assert got == want and a and b
    assert spikes.implausible(_stream(spark, rows).limit(0)).count() == 0


def _bins(values):
    out = {}
    for v in values:
        b = out.setdefault(int(math.floor(math.log2(v) * 16)), {"field": "x", "hour": 0, "n": 0, "least": v, "most": v})
        b["n"], b["least"], b["most"] = b["n"] + 1, min(b["least"], v), max(b["most"], v)
    return list(out.values())


def test_the_fit_decides(monkeypatch):
    """A top reading a bit more than twice the next is normal in a heavy tail and a spike beyond a light one."""
    rules, n = spikes.SpikeRules(risk=0.05), 400
    r = random.Random(1)
    octaves = sorted(r.expovariate(1 / 5) for _ in range(n - 1))
    heavy = [2**x for x in octaves] + [2 ** (octaves[-1] + 1.05)]
    light = [2 ** (0.3 * i / n) for i in range(n - 1)] + [2 ** (0.3 + 1.05)]
    assert spikes._limits_of(_bins(heavy), "x", rules)[1] is None
    assert spikes._limits_of(_bins(light), "x", rules)[1] == light[-1]
    monkeypatch.setattr(spikes, "cutoff", lambda *a: -math.inf)  # without the fit the factor alone would decide
    assert spikes._limits_of(_bins(heavy), "x", rules)[1] is not None


def test_lower_risk_needs_more():
    rules, strict = spikes.SpikeRules(), spikes.SpikeRules(risk=0.01)
    x = np.array([-math.log(1 - (i + 0.5) / 300) for i in range(300)])
    one = np.ones(300)
    assert x[-1] * 0.7 < spikes.cutoff(x, one, rules) < spikes.cutoff(x, one, strict)
    assert spikes.cutoff(x[:8], one[:8], rules) >= x[7] * 0.5 and np.isfinite(spikes.cutoff(x[:2], one[:2], rules)) and np.isfinite(spikes.cutoff(x[:1], one[:1], rules))


def test_spikes_at_every_share(spark):
    r = random.Random(4)
    spike = {"n20": (20, [3.0, 5.5, 40.0]), "n40": (40, [4.0, 9.0, 30.0, 250.0]), "n60": (60, [5.0, 6.0, 7.0]), "n100": (100, [3.5, 9.0, 11.0, 45.0, 160.0, 900.0]),
             "n240": (240, [4.0, 6.5, 15.0, 33.0, 80.0, 200.0, 450.0, 1200.0]), "n240b": (240, [8.0, 9.0, 11.0, 13.0, 17.0, 21.0, 26.0, 31.0, 37.0, 44.0]), "n400": (400, [9.0, 12.0, 15.0, 21.0, 30.0, 41.0, 55.0, 70.0])}
    rows, want = [], set()
    for h, (n, high) in spike.items():
        at = dict(zip(r.sample(range(n), len(high)), high))
        for i in range(n):
            if i in at:
                want.add((len(rows), "request_time"))
            rows.append((len(rows), T0 + timedelta(minutes=17 * i), h, at.get(i, r.uniform(0.1, 0.6)), None, None))
    for i in range(100):  # a shift for good
        rows.append((len(rows), T0 + timedelta(minutes=17 * i), "shifted", r.uniform(0.1, 0.3) if i < 75 else r.uniform(6, 14), None, None))
    for i in range(200):  # now and then a slow request
        rows.append((len(rows), T0 + timedelta(minutes=17 * i), "slow", r.uniform(1.5, 4) if i % 33 == 5 else r.uniform(0.1, 0.5), None, None))
    assert {tuple(x) for x in spikes.implausible(_stream(spark, rows)).collect()} == want


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_stuck_runs_over_partitions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spikes, "BROADCAST_ROWS", broadcast)
    r = random.Random(7)
    rows = []
    for h in ("x", "y"):
        v, n = 0.5, 0
        for i in range(900):
            if r.random() < 0.12:
                v = r.choice([0.0, 0.5, 1.5, 2.5])
            rows.append((len(rows), T0 + timedelta(seconds=i // 3), h, None if r.random() < 0.2 else v, None, 4096 if i < 400 else None))
    want = set()
    for h in ("x", "y"):
        for f, k in (("request_time", 3), ("memory_footprint", 5)):
            own = [x for x in sorted(rows, key=lambda x: (x[1], x[0])) if x[2] == h and x[k] is not None]
            at = 0
            while at < len(own):
                end = at
                while end < len(own) and own[end][k] == own[at][k]:
                    end += 1
                if end - at >= 8 and own[at][k] != 0:
                    want |= {(x[0], f) for x in own[at:end]}
                at = end
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(x) for x in spikes.implausible(_stream(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, strict):
    """Against brute force; hot key, ties, nulls, clashing names, keys without a match."""
    r = random.Random(2)
    left = [(i, r.choice(["hot", "hot", "a", "b", "none", None]), r.choice([None, *range(300)]), "x") for i in range(400)]
    right = [(r.choice(["hot", "a", "b", None]), r.choice([None, *range(300)]), i) for i in range(80)]
    a = spark.createDataFrame(left, "id int, k string, t bigint, v string")
    b = spark.createDataFrame(right, "k string, at bigint, v int")
    got = {x.id: (x.at, x.v_right) for x in asof_join(a, b, ["k"], "t", "at", 50, strict).collect()}
    want = {}
    for i, k, t, _ in left:
        fit = [(at, v) for rk, at, v in right if k is not None and rk == k and t is not None and at is not None and (at < t or at == t and not strict)]
        want[i] = max(fit) if fit else (None, None)
    assert got == want
    assert asof_join(a.limit(0), b, ["k"], "t", "at", 50).count() == 0 and asof_join(a, b.limit(0), ["k"], "t", "at", 50).where("at is null").count() == 400
