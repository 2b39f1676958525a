import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from ticktally.llm import pack


def _place(p, sizes):
    """Bins of a packing, by expanding its allotments."""
    bins = defaultdict(list)
    taken = Counter()
    for a in sorted(p.allotments, key=lambda a: (a.size, a.rank)):
        assert a.rank == taken[a.size] and a.count > 0
        for i in range(a.count):
            bins[a.bin + i // a.per].append(a.size)
        taken[a.size] += a.count
    assert taken == Counter({s: n for s, n in sizes.items() if n})
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_every_item_once_within_capacity(sizes):
    p = pack.pack_histogram(sizes, 60)
    bins = _place(p, sizes)
    assert len(bins) == p.bins and all(sum(b) <= 60 for b in bins.values())
    large = [sum(3 * s > 60 for s in b) for b in bins.values()]
    assert max(large, default=0) <= 2
    volume = -(-sum(s * n for s, n in sizes.items()) // 60)
    halves = sum(n for s, n in sizes.items() if 2 * s > 60)  # no two of them share a container
    thirds = -(-sum(n for s, n in sizes.items() if 3 * s > 60) // 2)
    assert p.bins <= 1.7 * max(volume, halves, thirds) + 1


def test_tight():
    r = random.Random(1)
    sizes = Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(20_000))
    p = pack.pack_histogram(sizes, 2048)
    bins = _place(p, sizes)
    volume = sum(s * n for s, n in sizes.items())
    assert volume / (len(bins) * 2048) > 0.97
    assert len(p.allotments) < 6 * len(sizes)


def test_items(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.choice([0, 3, 7, 50, 50, 120, 333])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, src string, n bigint")
    out = pack.pack_items(df, "id", "n", {1: (100, None), 2: (64, "b")}, "src").collect()
    for plan, cap, own in ((1, 100, rows), (2, 64, [x for x in rows if x[1] == "b"])):
        mine = [x for x in out if x.plan_id == plan]
        got = defaultdict(list)
        for x in mine:
            got[x.id].append((x.piece_no, x.token_start, x.n_tokens))
            assert (x.bin_id is None) == (x.n_tokens == 0)
        assert set(got) == {i for i, _, _ in own}
        for i, _, n in own:
            pieces = sorted(got[i])
            assert sum(p[2] for p in pieces) == n and [p[0] for p in pieces] == list(range(len(pieces)))
            assert [p[2] for p in pieces[:-1]] == [cap] * (len(pieces) - 1) and len(pieces) == max(1, -(-n // cap))
        fill = Counter()
        for x in mine:
            if x.bin_id is not None:
                fill[x.bin_id] += x.n_tokens
        assert max(fill.values()) <= cap and set(fill) == set(range(len(fill)))


def test_ranks_without_a_task_per_group(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 1 else id % 50 end as g")
    ranks = defaultdict(list)
    for x in pack.ranked(df, ["g"], ["id"]).collect():
        ranks[x.g].append(x["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, src string, n bigint")
    assert pack.pack_items(df, "id", "n", {1: (100, None)}, "src").count() == 0
    df = spark.createDataFrame([(1, None, 0)], "id bigint, src string, n bigint")
    assert [x.bin_id for x in pack.pack_items(df, "id", "n", {1: (100, None)}, "src").collect()] == [None]
    assert pack.pack_histogram({}, 10).bins == 0
