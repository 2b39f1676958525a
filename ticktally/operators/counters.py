"""Why requests and timers did or didn't enter a report: one reason per row, one aggregate."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import all_of, first_tag
from ..plans.conf import ReportConf
from .filters import request_filter, request_key, timer_filter, timer_tag_names
from .source import Source

NAMES = (
    "packets_received", "packets_aggregated", "packets_dropped_by_bloom", "packets_dropped_by_filters", "packets_dropped_by_rfield", "packets_dropped_by_rtag", "packets_dropped_by_timertag",
    "timers_scanned", "timers_aggregated", "timers_skipped_by_bloom", "timers_skipped_by_filters", "timers_skipped_by_tags",
)


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns, F.lit(False))


_OUTCOMES = ("scanned", "bloom", "tfilter", "ttags", "kept")


def _flat_outcomes(timers: DataFrame, conf: ReportConf, wanted: list[str]) -> DataFrame:
    """(request_id, names, counts): what became of a request's timers, without gathering them."""
    tags = F.col("tags")
    keyed = reduce(and_, [first_tag(tags, k.name).isNotNull() for k in conf.keys if k.kind == "ttag"], F.lit(True))
    outcome = F.when(~all_of(tags["name"], wanted), "bloom").when(~timer_filter(conf, tags), "tfilter").when(~keyed, "ttags").otherwise("kept")
    t = timers.select("request_id", outcome.alias("o"), *[F.array_contains(tags["name"], n).alias(f"__n{i}") for i, n in enumerate(wanted)])
    counts = [F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("o") == c).alias(c) for c in _OUTCOMES[1:]], *[F.max(f"__n{i}").alias(f"__n{i}") for i in range(len(wanted))]]
    names = reduce(and_, [F.col(f"__n{i}") for i in range(len(wanted))], F.lit(True))
    return t.groupBy("request_id").agg(*counts).select("request_id", names.alias("names"), *_OUTCOMES)


def counters(source: Source, conf: ReportConf, time_unit: str = "s") -> DataFrame:
    """One row of counts.  Checks apply in the order bloom, filters, request tags, request fields, timers;
    "bloom" is exact here: the tag names a report needs are in the request (timer) or not."""
    wanted = timer_tag_names(conf)
    r = source.requests
    no_filter = ~request_filter(conf, time_unit)
    no_rtag = _any([request_key(k).isNull() for k in conf.keys if k.kind == "rtag"])
    if conf.kind != "timer":
        r = r.select(F.when(no_filter, "filters").when(no_rtag, "rtag").alias("reason"), F.lit(0).alias("scanned"), *[F.lit(0).alias(x) for x in ("bloom", "tfilter", "ttags", "kept")])
    elif source.timers is not None:
        no_field = _any([F.col(k.name) == "" for k in conf.keys if k.kind == "field"])
        per = _flat_outcomes(source.timers, conf, wanted)
        first = F.when(~F.coalesce("names", F.lit(not wanted)), "bloom").when(no_filter, "filters").when(no_rtag, "rtag").when(no_field, "rfield")
        r = r.join(per, "request_id", "left").select(first.alias("early"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _OUTCOMES])
        r = r.select(F.coalesce("early", F.when(F.col("kept") == 0, "timertag")).alias("reason"), *[F.when(F.col("early").isNull(), F.col(c)).otherwise(0).alias(c) for c in _OUTCOMES])
    else:
        no_field = _any([F.col(k.name) == "" for k in conf.keys if k.kind == "field"])
        names = F.flatten(F.transform("timers", lambda t: t["tags"]["name"]))
        has = lambda t: all_of(t["tags"]["name"], wanted)
        keyed = lambda t: reduce(and_, [first_tag(t["tags"], k.name).isNotNull() for k in conf.keys if k.kind == "ttag"], F.lit(True))
        outcome = F.transform("timers", lambda t: F.when(~has(t), "bloom").when(~timer_filter(conf, t["tags"]), "filters").when(~keyed(t), "tags").otherwise("kept"))
        first = F.when(~all_of(names, wanted), "bloom").when(no_filter, "filters").when(no_rtag, "rtag").when(no_field, "rfield")
        r = r.select(first.alias("early"), outcome.alias("o"))
        n = lambda what: F.when(F.col("early").isNull(), F.size(F.filter("o", lambda x: x == what))).otherwise(0)
        r = r.select("early", F.when(F.col("early").isNull(), F.size("o")).otherwise(0).alias("scanned"), n("bloom").alias("bloom"), n("filters").alias("tfilter"), n("tags").alias("ttags"), n("kept").alias("kept"))
        r = r.withColumn("reason", F.coalesce("early", F.when(F.col("kept") == 0, "timertag"))).drop("early")
    return r.agg(*_sums({c: F.col(c) for c in ("reason", *_OUTCOMES)}))


def _sums(x) -> list[Column]:
    """The counters of rows with a reason and counts of timers."""
    lost = lambda what: F.count_if(x["reason"] == what)
    s = lambda c: F.coalesce(F.sum(x[c]), F.lit(0)).cast("bigint")
    columns = (
        F.count(F.lit(1)), F.count_if(x["reason"].isNull()), *[lost(w) for w in ("bloom", "filters", "rfield", "rtag", "timertag")],
        s("scanned"), s("kept"), s("bloom"), s("tfilter"), s("ttags"),
    )
    return [c.alias(n) for c, n in zip(columns, NAMES)]


def counters_of(source: Source, confs: dict[str, ReportConf], time_unit: str = "s") -> DataFrame:
    """(name, counts): the counters of many reports from one pass over the requests."""
    names = list(confs)
    if not names:
        raise ValueError("no reports")
    timed = any(c.kind == "timer" for c in confs.values())
    r = source.nested() if timed else source.requests
    r = r.select(*[_outcome(c, time_unit).alias(f"__c{i}") for i, c in enumerate(confs.values())])
    sums = r.agg(*[F.struct(*_sums(F.col(f"__c{i}"))).alias(f"__c{i}") for i in range(len(names))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"__c{i}").alias("c")) for i, n in enumerate(names)]))
    return sums.select(rows.alias("x")).select("x.name", "x.c.*")


def _outcome(conf: ReportConf, time_unit: str) -> Column:
    """struct(reason, counts of timers) of a request with its timers inside."""
    zero = F.lit(0)
    no_filter, no_rtag = ~request_filter(conf, time_unit), _any([request_key(k).isNull() for k in conf.keys if k.kind == "rtag"])
    if conf.kind != "timer":
        return F.struct(F.when(no_filter, "filters").when(no_rtag, "rtag").alias("reason"), *[zero.alias(x) for x in _OUTCOMES])
    wanted = timer_tag_names(conf)
    no_field = _any([F.col(k.name) == "" for k in conf.keys if k.kind == "field"])
    tag_names = F.flatten(F.transform("timers", lambda t: t["tags"]["name"]))
    keyed = lambda t: reduce(and_, [first_tag(t["tags"], k.name).isNotNull() for k in conf.keys if k.kind == "ttag"], F.lit(True))
    each = F.transform("timers", lambda t: F.when(~all_of(t["tags"]["name"], wanted), "bloom").when(~timer_filter(conf, t["tags"]), "tfilter").when(~keyed(t), "ttags").otherwise("kept"))
    early = F.when(~all_of(tag_names, wanted), "bloom").when(no_filter, "filters").when(no_rtag, "rtag").when(no_field, "rfield")
    n = {what: F.when(early.isNull(), F.size(F.filter(each, lambda x: x == what))).otherwise(zero) for what in _OUTCOMES[1:]}
    scanned = F.when(early.isNull(), F.size("timers")).otherwise(zero)
    return F.struct(F.coalesce(early, F.when(n["kept"] == 0, "timertag")).alias("reason"), scanned.alias("scanned"), *[c.alias(x) for x, c in n.items()])
