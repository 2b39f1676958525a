"""As-of join: to every row of the left side the newest row of the right side at or before its time.

Time is cut into buckets, and rows of both sides meet by (keys, bucket), so that a key with most of
the rows is spread over its buckets.  What a bucket inherits is the newest earlier row of the right
side, found on one summary row per key and bucket.  No pairs are formed: both sides are put in one
order, and the newest right row so far is carried along.

Cases: left rows without an earlier right row keep nulls; null keys or times match nothing; of right
rows of equal time the one with the greatest value wins; repeated left rows stay; columns of the right
side that clash with the left's get the suffix ``_right``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, width: int, strict: bool = False) -> DataFrame:
    """``width``: of a bucket, in the unit of the times (whole numbers); ``strict`` leaves out rows of equal time."""
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    names = {c: f"{c}_right" if c in left.columns else c for c in values}
    row = F.struct(F.col(right_time).alias("__t"), *[F.col(c).alias(names[c]) for c in values])
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    r = right.where(usable).select(*keys, bucket(right_time).alias("__b"), F.col(right_time).alias("__at"), row.alias("__row"))
    le = left.select("*", bucket(left_time).alias("__b"), F.col(left_time).alias("__at"))
    # one row per key and bucket of either side, with the newest right row of earlier buckets
    own = r.groupBy(*keys, "__b").agg(F.max("__row").alias("__row")).unionByName(le.select(*keys, "__b").distinct().withColumn("__row", F.lit(None).cast(r.schema["__row"].dataType)))
    own = own.groupBy(*keys, "__b").agg(F.max("__row").alias("__row"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inherited = own.select(*keys, "__b", F.last("__row", ignorenulls=True).over(before).alias("__row")).where(F.col("__row").isNotNull())
    side = 1 if not strict else -1  # right rows go before left rows of the same time, or after them
    rest = [c for c in left.columns if c not in keys]
    lefts = le.select(*keys, "__b", "__at", F.lit(0).alias("__side"), F.struct(*rest).alias("__left"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"))
    empty = F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left")
    rights = r.select(*keys, "__b", "__at", F.lit(-side).alias("__side"), empty, "__row")
    carried = inherited.select(*keys, "__b", (F.col("__b") * width).cast(lefts.schema["__at"].dataType).alias("__at"), F.lit(-2).alias("__side"), empty, "__row")
    order = Window.partitionBy(*keys, "__b").orderBy("__at", "__side", "__row").rowsBetween(Window.unboundedPreceding, 0)
    joined = lefts.unionByName(rights).unionByName(carried).withColumn("__found", F.last("__row", ignorenulls=True).over(order)).where(F.col("__left").isNotNull())
    return joined.select(*keys, *[F.col(f"__left.{c}").alias(c) for c in rest], *[F.col(f"__found.{names[c]}").alias(names[c]) for c in values])
