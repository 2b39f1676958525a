import random
from collections import Counter

import pyarrow as pa
import pytest

from ticktally.llm import lossy


def _zipf(n, seed):
    r = random.Random(seed)
    return [f"v{int(r.paretovariate(0.7))}" for _ in range(n)]


@pytest.mark.parametrize("error", [0.001, 0.01, 0.1])
def test_bounds_of_one_stream(error):
    values = _zipf(20_000, 1)
    c = lossy.LossyCounter(error)
    for at in range(0, len(values), 777):
        c.add(pa.array(values[at : at + 777]))
    true = Counter(values)
    assert c.rows == len(values) and len(c.entries) < (12 + lossy.STRIDE) / error
    for v, n in true.items():
        low, delta = c.entries.get(v, (0, c.pruned))
        assert low <= n <= low + delta and delta <= error * len(values)


def test_merge_over_partitions(spark):
    values = _zipf(30_000, 2) + ["hot"] * 15_000
    random.Random(3).shuffle(values)
    values += [None] * 500 + [""] * 400
    df = spark.createDataFrame([(v, "x", i) for i, v in enumerate(values)], "a string, b string, item int").repartition(7)
    true = Counter(v for v in values if v is not None)
    merged = lossy.merge_summaries(lossy.lossy_summaries(df, ["a", "b"], 0.002)).collect()
    for r in merged:
        n = true[r.item] if r.field_name == "a" else len(values)
        assert r.low <= n <= r.high and r.high - r.low <= 0.002 * len(values) + 1
    got = {r.item for r in lossy.frequent_items(df, ["a"], 0.02, 0.002, len(values)).collect()}
    assert {v for v, n in true.items() if n >= 0.02 * len(values)} <= got <= {v for v, n in true.items() if n >= 0.017 * len(values)}


def test_empty(spark):
    df = spark.createDataFrame([], "a string")
    assert lossy.frequent_items(df, ["a"], 0.01, 0.001, 0).count() == 0
    assert lossy.frequent_items(spark.createDataFrame([(None,)] * 5, "a string"), ["a"], 0.01, 0.001, 5).count() == 0
