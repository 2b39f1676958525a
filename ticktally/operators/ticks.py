"""Tick tables: partial aggregates per time slice, and reports merged from the slices of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.conf import ReportConf
from .filters import key_names
from .report import MEASURES, aggregate_rows, derived, histogram_rows, percentile_columns, request_rows, timer_rows
from .source import Source


def _ticked(source: Source, conf: ReportConf) -> Source:
    tick = (F.floor(F.unix_seconds("ts") / conf.tick_sec) * conf.tick_sec).cast("bigint")
    return Source(source.requests.withColumn("tick", tick), source.timers)


def _rows(source: Source, conf: ReportConf, gather: bool = False) -> DataFrame:
    if conf.kind == "request":
        return request_rows(source, conf, extra=("tick",))
    return timer_rows(source, conf, extra=("tick",), gather=gather)


def tick_table(source: Source, conf: ReportConf) -> DataFrame:
    """(tick, keys, measures): what a report keeps of each slice."""
    s = _ticked(source, conf)
    return aggregate_rows(_rows(s, conf, gather=True), s, conf, ["tick", *key_names(conf)])


def tick_histograms(source: Source, conf: ReportConf) -> DataFrame:
    """(tick, keys, cls, id, cnt)."""
    return histogram_rows(_rows(_ticked(source, conf), conf), conf, ["tick", *key_names(conf)])


def last_ticks(ticks: DataFrame, conf: ReportConf, as_of_sec: int) -> DataFrame:
    """Completed slices of the window that ends at ``as_of_sec``; a partitioned tick table is pruned by it."""
    end = as_of_sec // conf.tick_sec * conf.tick_sec
    return ticks.where((F.col("tick") < end) & (F.col("tick") >= end - conf.window_sec))


def merged(ticks: DataFrame, conf: ReportConf, histograms: DataFrame | None = None) -> DataFrame:
    """The report of the given slices."""
    names = key_names(conf)
    agg = ticks.groupBy(*names).agg(*[F.sum(m).alias(m) for m, _, _ in MEASURES[conf.kind]])
    out = derived(agg, conf, names)
    if histograms is not None:
        h = histograms.groupBy(*names, "cls", "id").agg(F.sum("cnt").alias("cnt"))
        out = out.join(percentile_columns(h, conf, names), names, "left")  # on the same partitioning
    return out


def approx_rows(ticks: DataFrame, names: list[str]) -> DataFrame:
    """Estimated rows of the merged report, without merging it."""
    return ticks.agg(F.approx_count_distinct(F.struct(*names)).alias("approx_row_count"))
