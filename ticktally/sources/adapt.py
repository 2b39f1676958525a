"""Request sources made of tables: the metrics tables, and requests derived from orders, line items or events."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import to_ns
from ..operators.dedup import distinct_rows
from ..operators.source import TAGS, TIMERS, Source
from ..session import table


def tag_array(*pairs: tuple[str, Column]) -> Column:
    """Tags of the pairs, in order; a pair whose value is null becomes a tag named ``-`` that no report asks for,
    so that the array is a plain constructor the optimizer sees through."""
    return F.array(*[F.struct(F.when(v.isNotNull(), F.lit(n)).otherwise("-").alias("name"), F.coalesce(v, F.lit("")).alias("value")) for n, v in pairs])


def from_orders(spark: SparkSession, d: str, flat: bool = False) -> Source:
    """Orders as requests, line items as their timers; blank servers and absent or repeated tags included."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    r = o.select(
        k.alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("host-"), (F.col("o_custkey") % 10).cast("string")).alias("host"),
        F.when(k % 17 == 0, "").otherwise(F.col("o_orderpriority")).alias("server"),
        F.concat(F.lit("script-"), (k % 20).cast("string")).alias("script"),
        F.when(k % 2 == 0, "https").otherwise("http").alias("schema"),
        F.when(F.col("o_orderstatus") == "F", "200").when(F.col("o_orderstatus") == "O", "404").otherwise("500").alias("status"),
        (k % 5000).cast("bigint").alias("traffic"), (F.col("o_custkey") * 1024).cast("bigint").alias("mem_used"),
        F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("request_time_ns"),
        F.round(F.col("o_totalprice") * 400).cast("bigint").alias("ru_utime_ns"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("ru_stime_ns"),
        tag_array(
            ("app", F.when(k % 11 != 0, F.concat(F.lit("app-"), (F.col("o_custkey") % 7).cast("string")))),
            ("app", F.when(k % 13 == 0, F.lit("app-again"))),
            ("prio", F.substring("o_orderpriority", 1, 1)),
        ).alias("tags"),
    )
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_quantity").cast("bigint").alias("hit_count"),
        F.round(F.col("l_extendedprice") * 10000).cast("bigint").alias("value_ns"),
        F.round(F.col("l_discount") * 1e9).cast("bigint").alias("ru_utime_ns"), F.round(F.col("l_tax") * 1e9).cast("bigint").alias("ru_stime_ns"),
        tag_array(
            ("flag", F.col("l_returnflag")), ("state", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linestatus"))),
            ("supp", F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string"))), ("flag", F.when(F.col("l_partkey") % 19 == 0, F.lit("X"))),
        ).alias("tags"),
    )
    s = Source(r, t)
    return s if flat else Source(s.nested())


def from_events(spark: SparkSession, d: str) -> Source:
    """Events as requests without timers."""
    e = table(spark, d, "events")
    ns = F.round(F.coalesce("value", F.lit(0.0)) * 1e6).cast("bigint")
    r = e.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.lit("events").alias("server"), F.col("event_type").alias("script"),
        F.lit("http").alias("schema"), F.lit("200").alias("status"), F.lit(1).cast("bigint").alias("traffic"), F.lit(0).cast("bigint").alias("mem_used"), ns.alias("request_time_ns"), F.lit(0).cast("bigint").alias("ru_utime_ns"), F.lit(0).cast("bigint").alias("ru_stime_ns"),
        tag_array(("k", F.get_json_object("props", "$.k"))).alias("tags"), F.array().cast(TIMERS).alias("timers"),
    )
    return Source(r)


def _clean(seconds: Column) -> Column:
    """A duration of the wire as nanoseconds; not finite is null, negative is 0."""
    s = seconds.cast("double")
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), None).otherwise(to_ns(F.greatest(s, F.lit(0.0))))


def from_metrics(spark: SparkSession, d: str) -> Source:
    """The metrics tables: distinct requests with their finite measurements, distinct timers."""
    cols = ["request_id", "ts", "hostname", "server_name", "script_name", "schema_name", "status", "document_size", "memory_footprint", "request_time", "ru_utime", "ru_stime"]
    raw = distinct_rows(table(spark, d, "requests"), cols)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    r = raw.select(
        "request_id", "ts", blank("hostname").alias("host"), blank("server_name").alias("server"), blank("script_name").alias("script"), blank("schema_name").alias("schema"), F.coalesce("status", F.lit(0)).cast("string").alias("status"),
        zero(F.col("document_size")).alias("traffic"), zero(F.col("memory_footprint")).alias("mem_used"), zero(_clean(F.col("request_time"))).alias("request_time_ns"), zero(_clean(F.col("ru_utime"))).alias("ru_utime_ns"), zero(_clean(F.col("ru_stime"))).alias("ru_stime_ns"),
        F.array().cast(TAGS).alias("tags"),
    )
    t = table(spark, d, "timers").dropDuplicates(["request_id", "timer_no"])
    t = t.where((F.col("timer_value") >= 0) & (F.col("timer_value") < float("inf")) & (F.col("hit_count") > 0))
    t = t.select("request_id", "hit_count", to_ns(F.col("timer_value")).alias("value_ns"), zero(_clean(F.col("timer_ru_utime"))).alias("ru_utime_ns"), zero(_clean(F.col("timer_ru_stime"))).alias("ru_stime_ns"), F.coalesce("tags", F.array().cast(TAGS)).cast(TAGS).alias("tags"))
    return Source(r, t)

