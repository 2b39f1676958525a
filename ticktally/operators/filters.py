"""Report filters and keys as column expressions, pushed below every explode and shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import every_tag_is, first_tag
from ..plans.conf import Key, ReportConf


def request_filter(conf: ReportConf, time_unit: str = "s") -> Column:
    """min_time <= request_time < max_time, request fields, first request tags; all must hold."""
    out = [F.lit(True)]
    if conf.min_time:
        out.append(F.col("request_time_ns") >= conf.bound_ns("min", time_unit))
    if conf.max_time:
        out.append(F.col("request_time_ns") < conf.bound_ns("max", time_unit))
    for key, value in conf.filters:
        if key.kind == "field":
            out.append(F.col(key.name) == value)
        elif key.kind == "rtag":
            out.append(F.coalesce(first_tag(F.col("tags"), key.name) == value, F.lit(False)))
    return reduce(and_, out)


def timer_filter(conf: ReportConf, tags: Column) -> Column:
    """Every occurrence of a filtered timer tag has the value."""
    return reduce(and_, [every_tag_is(tags, k.name, v) for k, v in conf.filters if k.kind == "ttag"], F.lit(True))


def timer_tag_names(conf: ReportConf) -> list[str]:
    return sorted({k.name for k in (*conf.keys, *(k for k, _ in conf.filters)) if k.kind == "ttag"})


def request_key(key: Key) -> Column:
    return F.col(key.name) if key.kind == "field" else first_tag(F.col("tags"), key.name)


def request_keys_present(conf: ReportConf) -> Column:
    """Request tags of keys must be there; timer reports also drop requests with an empty key field."""
    out = [F.lit(True)]
    for k in conf.keys:
        if k.kind == "rtag":
            out.append(request_key(k).isNotNull())
        elif k.kind == "field" and conf.kind == "timer":
            out.append(F.col(k.name) != "")
    return reduce(and_, out)


#: Names of columns that reports use inside or show beside their keys.
_STEMS = ("req", "req_time", "ru_utime", "ru_stime", "traffic", "memory", "hit", "time")
RESERVED = frozenset(
    {f"{stem}_{end}" for stem in _STEMS for end in ("count", "total", "per_sec", "percent")}
    | set("req hit hits time utime stime traffic mem request_id ts tick slice day batch cls id cnt tags timers hit_count value_ns memory_footprint timer_count histogram_data".split())
    | set("mem_used request_time_ns ru_utime_ns ru_stime_ns".split())
)


def key_names(conf: ReportConf) -> list[str]:
    """Column names of keys: the key's own name, numbered where it repeats or stands for something else in a
    report (``RESERVED``, its percentiles, names with two leading underscores); letters' case does not tell names apart."""
    out: list[str] = []
    for k in conf.keys:
        taken = {x.lower() for x in out} | {p for p, _ in conf.percentiles}
        free = lambda x: x.lower() not in taken and x.lower() not in RESERVED and not x.startswith("__")  # noqa: B023, E731
        name, n = k.name, 2
        while not free(name):
            name, n = f"{k.name.lstrip('_')}_{n}", n + 1
        out.append(name)
    return out
