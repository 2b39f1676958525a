"""Most frequent items in bounded memory: lossy counting.

Every partition keeps entries (item, count, delta).  Rows are taken in buckets of ``1/error``
rows; an item that enters in bucket b may have been seen up to b - 1 times before (its delta);
the entries with count + delta <= b are dropped at bucket boundaries, every ``STRIDE``-th of them,
and an item's delta is the number of the bucket of the last such boundary.  A partition of n rows
so holds at most ``log(error n)/error + STRIDE/error`` entries and undercounts nothing by more than
``error n``.

Summaries of partitions are merged by sums: counts and deltas of an item's entries, plus, for
partitions without an entry, the number of their buckets up to the last pruning.  An item's true count lies in
[count, count + delta].  An item is reported if the interval reaches the support; where it
straddles the support, an exact count of those few items (at most ``2/support``) decides.

Cases: nulls are not items, the empty string is one; ties are all reported; an empty column
gives no rows; repeated rows are the caller's to remove.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STRIDE = 16  # buckets between two prunings


class LossyCounter:
    """Lossy counting of one stream; see the module's text."""

    def __init__(self, error: float):
        self.width = max(1, int(1 / error))
        self.entries: dict[str, list[int]] = {}
        self.rows = self.pruned = 0

    @property
    def buckets(self) -> int:
        return self.rows // self.width

    def add(self, values: pa.Array) -> None:
        values = values.drop_null()
        at, stretch = 0, self.width * STRIDE
        while at < len(values):
            step = min(len(values) - at, stretch - self.rows % stretch)
            entries, before = self.entries, self.pruned
            counted = pc.value_counts(values.slice(at, step))
            for item, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                e = entries.get(item)
                if e is None:
                    entries[item] = [n, before]
                else:
                    e[0] += n
            self.rows += step
            at += step
            if self.rows % stretch == 0:
                b = self.pruned = self.buckets
                self.entries = {k: e for k, e in entries.items() if e[0] + e[1] > b}


def lossy_summaries(df: DataFrame, fields: Sequence[str], error: float) -> DataFrame:
    """One row per partition, field and entry (field, part, item, count, delta, buckets, rows); item null in the partition's header."""
    schema = pa.schema([("field_name", pa.string()), ("part", pa.int32()), ("item", pa.string()), ("count", pa.int64()), ("delta", pa.int64()), ("buckets", pa.int64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counters = TaskContext.get().partitionId(), [LossyCounter(error) for _ in fields]
        for b in batches:
            for i, c in enumerate(counters):
                c.add(b.column(i))
        for f, c in zip(fields, counters):
            rows = [(f, part, None, 0, 0, c.pruned, c.rows), *((f, part, k, n, d, c.pruned, 0) for k, (n, d) in c.entries.items())]
            yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*rows), schema)], schema=schema)

    return df.select(*fields).mapInArrow(run, "field_name string, part int, item string, count bigint, delta bigint, buckets bigint, rows bigint")


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """(field_name, item, low, high, rows): intervals that hold every item's true count."""
    items = summaries.groupBy("field_name", "item").agg(F.sum("count").alias("low"), F.sum("delta").alias("delta"), F.sum("buckets").alias("seen"), F.sum("rows").alias("rows"))
    totals = items.where(F.col("item").isNull()).select("field_name", F.col("seen").alias("all_buckets"), F.col("rows").alias("total"))  # one row per field
    merged = items.where(F.col("item").isNotNull()).join(F.broadcast(totals), "field_name")
    return merged.select("field_name", "item", "low", (F.col("low") + F.col("delta") + F.col("all_buckets") - F.col("seen")).alias("high"), F.col("total").alias("rows"))


def frequent_items(df: DataFrame, fields: Sequence[str], support: float, error: float, total: int) -> DataFrame:
    """Items whose interval reaches ``support * total``: (field_name, item, low, high, guaranteed)."""
    least = support * total
    return merge_summaries(lossy_summaries(df, fields, error)).where(F.col("high") >= least).select("field_name", "item", "low", "high", (F.col("low") >= least).alias("guaranteed"))
