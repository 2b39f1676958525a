import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktally.llm import quantile


@pytest.mark.parametrize("order", ["random", "sorted", "reversed", "ties"])
def test_certified_bounds(order):
    v = np.random.default_rng(1).lognormal(size=40_000)
    v = {"random": v, "sorted": np.sort(v), "reversed": np.sort(v)[::-1], "ties": np.round(v)}[order]
    s = quantile.Sketch(64)
    for at in range(0, len(v), 997):
        s.add(v[at : at + 997])
    assert s.n == len(v) and max(s.over, s.under) <= len(v) / 128 * np.log2(len(v) / 64)
    assert len(s.buffers) <= 12 and all(len(b) == 64 for b in s.buffers.values()) and len(s.raw) < 64
    for x in np.quantile(v, [0, 0.01, 0.5, 0.9, 0.999, 1]):
        true = int((v < x).sum())
        assert s.rank_below(x) - s.over <= true <= s.rank_below(x) + s.under


def _frame(spark, n=30_000):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.5 else f"g{r.randint(0, 400)}", i % 3, r.lognormvariate(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, day int, value double")


def test_sketches_of_groups_and_days(spark):
    rows, df = _frame(spark)
    part = quantile.partial_sketches(df.repartition(6), ["g", "day"], "value", k=128)
    daily = quantile.merge_sketches(part, ["g", "day"], F.spark_partition_id(), 6, k=128)
    total = quantile.merge_sketches(daily, ["g"], F.col("day"), 3, k=128).collect()
    true = {}
    for g, _, v in rows:
        true.setdefault(g, []).append(v)
    assert {r.g: r.n for r in total} == {g: len(v) for g, v in true.items()}
    for r in total:
        v = np.sort(true[r.g])
        assert len(r.raw) < 128 and all(len(b.v) == 128 for b in r.buffers)
        assert len(r.raw) + sum(b.w * len(b.v) for b in r.buffers) == r.n
        if r.g != "hot":
            assert sorted(r.raw) == list(v) and r.over == r.under == 0 if r.n < 128 else True
        else:
            assert 0 < max(r.over, r.under) < 0.06 * r.n
        for x in np.quantile(v, [0.1, 0.5, 0.99]):
            est = sum(y < x for y in r.raw) + sum(b.w * sum(y < x for y in b.v) for b in r.buffers)
            assert est - r.over <= (v < x).sum() <= est + r.under


def test_percentile_values(spark):
    rows, df = _frame(spark, 6000)
    s = quantile.merge_sketches(quantile.partial_sketches(df, ["g"], "value", k=256), ["g"], F.lit(0), 1, k=256)
    for r in quantile.percentiles(s, ["g"], (1, 50, 99, 100)).collect():
        v = np.sort([x for g, _, x in rows if g == r.g])
        lo = int(np.searchsorted(v, r.value, "left")) / len(v)
        hi = int(np.searchsorted(v, r.value, "right")) / len(v)
        assert lo - r.rank_error - 1e-9 <= r.pct / 100 <= hi + r.rank_error + 2 / len(v)
        if r.rank_error == 0:
            assert r.value == v[max(0, int(np.ceil(r.pct * len(v) / 100)) - 1)]


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert quantile.merge_sketches(quantile.partial_sketches(df, ["g"], "value"), ["g"], F.lit(0), 1).count() == 0
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 0.0)], "g string, value double")
    got = {r.g: r.n for r in quantile.merge_sketches(quantile.partial_sketches(df, ["g"], "value"), ["g"], F.lit(0), 1).collect()}
    assert got == {None: 2, "a": 1}


def test_levels_of_the_tree(spark, monkeypatch):
    """With a fan-in of 3, 20 pieces meet in three levels; no row pools more than three of them."""
    monkeypatch.setattr(quantile, "FAN_IN", 3)
    seen = []
    pool = quantile._pool
    monkeypatch.setattr(quantile, "_pool", lambda df, keys: seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0]) or pool(df, keys))
    rows, df = _frame(spark, 12_000)
    part = quantile.partial_sketches(df.repartition(20), ["g"], "value", k=64)
    total = {r.g: r for r in quantile.merge_sketches(part, ["g"], F.spark_partition_id(), 20, k=64).collect()}
    assert len(seen) == 3 and max(seen) <= 3
    v = np.sort([x for g, _, x in rows if g == "hot"])
    r = total["hot"]
    for x in np.quantile(v, [0.1, 0.5, 0.99]):
        est = sum(y < x for y in r.raw) + sum(b.w * sum(y < x for y in b.v) for b in r.buffers)
        assert est - r.over <= (v < x).sum() <= est + r.under
