"""Request sources of reports: nested (timers inside the request) or flat (timers in a table of their own)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = "array<struct<name:string,value:string>>"
TIMERS = f"array<struct<hit_count:bigint,value_ns:bigint,ru_utime_ns:bigint,ru_stime_ns:bigint,tags:{TAGS}>>"
COLUMNS = ("request_id", "ts", "host", "server", "script", "schema", "status", "traffic", "mem_used", "request_time_ns", "ru_utime_ns", "ru_stime_ns", "tags")
SCHEMA = f"request_id bigint, ts timestamp, host string, server string, script string, schema string, status string, traffic bigint, mem_used bigint, request_time_ns bigint, ru_utime_ns bigint, ru_stime_ns bigint, tags {TAGS}, timers {TIMERS}"


@dataclass(frozen=True)
class Source:
    """``requests`` has COLUMNS, and ``timers`` too unless a flat table of timers goes with it:
    (request_id, hit_count, value_ns, ru_utime_ns, ru_stime_ns, tags)."""

    requests: DataFrame
    timers: DataFrame | None = None

    def where(self, condition) -> Source:
        return Source(self.requests.where(condition), self.timers)

    def nested(self) -> DataFrame:
        """Requests with their timers inside."""
        if self.timers is None:
            return self.requests
        t = self.timers.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("hit_count", "value_ns", "ru_utime_ns", "ru_stime_ns", "tags"))).alias("timers"))
        return self.requests.join(t, "request_id", "left").withColumn("timers", F.coalesce("timers", F.array().cast(TIMERS)))
