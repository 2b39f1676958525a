import random
from collections import Counter, defaultdict

from ticktally.llm import mix
from ticktally.llm.mix import Target


def test_flow_is_cheapest():
    #  two ways of different cost and room
    arcs = [(0, 1, 5, 1), (0, 2, 5, 3), (1, 3, 9, 0), (2, 3, 9, 0), (3, 4, 7, 0)]
    assert mix.min_cost_flow(5, arcs, 0, 4) == [5, 2, 5, 2, 7]
    assert mix.min_cost_flow(2, [(0, 1, 0, 0)], 0, 1) == [0]


def test_route_plain():
    quota, got = mix.route({("a",): 100, ("b",): 50}, [Target("a", 3, 2), Target("b", 1, 1), Target("c", 1, 5), Target("z", 0, 1)], 500)
    assert quota == {"a": 300, "b": 100, "c": 100, "z": 0}
    flows = Counter()
    for p, r, s, lo, hi in got:
        assert hi - lo <= 100 and r <= 2
        flows[s] += hi - lo
    assert flows == {"a": 200, "b": 50}


def test_route_overlap():
    # b can only use the shared documents, so a must leave them to it
    quota, got = mix.route({("a",): 100, ("a", "b"): 100}, [Target("a", 1, 1), Target("b", 1, 1)], 200)
    flows = Counter()
    for p, r, s, lo, hi in got:
        flows[p, s] += hi - lo
    assert flows == {(("a",), "a"): 100, (("a", "b"), "b"): 100} and quota == {"a": 100, "b": 100}


def test_passes_fill_in_order():
    _, got = mix.route({("a",): 10}, [Target("a", 1, 4)], 25)
    assert sorted((r, lo, hi) for _, r, _, lo, hi in got) == [(1, 0, 10), (2, 0, 10), (3, 0, 5)]


def test_selection(spark):
    r = random.Random(6)
    rows = [(i, ["a"] if i % 3 else ["a", "b"] if i % 2 else [], r.choice([0, 5, 20, 60])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, pattern array<string>, n_tokens bigint")
    sums = defaultdict(int)
    for _, p, n in rows:
        sums[tuple(p)] += n
    targets = [Target("a", 2, 1), Target("b", 1, 3)]
    total = sum(sums.values())
    quota, flows = mix.route({p: s for p, s in sums.items() if p}, targets, total)
    out = mix.select(df.where("size(pattern) > 0"), "id", [(1, *f) for f in flows], 9).collect()
    got, seen = Counter(), Counter()
    pattern = {i: p for i, p, _ in rows}
    for x in out:
        assert x.source in pattern[x.id] and x.n_tokens > 0 and x.repeats <= {"a": 1, "b": 3}[x.source]
        got[x.source] += x.n_tokens * x.repeats
        seen[x.id] += x.repeats
    flowed = Counter()
    for p, _, s, lo, hi in flows:
        flowed[s] += hi - lo
    assert all(abs(got[s] - flowed[s]) <= 60 * len(flows) for s in flowed) and max(seen.values()) <= 3
    again = mix.select(df.where("size(pattern) > 0").repartition(9), "id", [(1, *f) for f in flows], 9).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_starts_are_prefix_sums(spark):
    df = spark.createDataFrame([(i, ["a"], i % 7 + 1) for i in range(2000)], "id bigint, pattern array<string>, n_tokens bigint")
    rows = sorted(mix.lines(df, "id", 1).collect(), key=lambda x: x.start)
    at = 0
    for x in rows:
        assert x.start == at
        at += x.n_tokens


def test_empty(spark):
    assert mix.route({}, [Target("a", 1, 2)], 100) == ({"a": 100}, [])
    assert mix.route({("a",): 5}, [Target("a", 0, 2)], 100)[1] == []
    df = spark.createDataFrame([], "id bigint, pattern array<string>, n_tokens bigint")
    assert mix.select(df, "id", [(1, ("a",), 1, "a", 0, 5)], 1).count() == 0
    assert mix.select(df, "id", [], 1).count() == 0
