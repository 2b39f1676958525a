"""Streaming ticks: slices of closed time kept as a table, and many reports fed by one stream.

A report's state is what its open slices hold; a watermark closes them in event time (``ts`` is
set on arrival where the source has no time of its own) and evicts their state.  With a histogram
a slice's rows are split by bucket, so that one aggregate keeps measures and histogram: measures
are the sums over buckets, percentiles come from the counts of buckets.  The slice table is
written partitioned by day, so that a window reads the days it needs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hist import bucket
from ..operators.filters import key_names
from ..operators.report import MEASURES, request_rows, timer_rows
from ..operators.source import Source
from ..operators.ticks import merged
from ..plans.conf import ReportConf


def _sliced(source: Source, conf: ReportConf, time_unit: str, slice_: str) -> DataFrame:
    """(slice, keys[, cls, id, cnt], measures): partial sums of slices; cls is null for timers without hits."""
    rows = (request_rows if conf.kind == "request" else timer_rows)(source, conf, time_unit, extra=(slice_,))
    by = [slice_, *key_names(conf)]
    sums = [F.sum(m).cast("bigint").alias(m) for m, _, _ in MEASURES[conf.kind]]
    if conf.histogram is None:
        return rows.groupBy(*by).agg(*sums)
    hits = F.col("hit") if conf.kind == "timer" else F.lit(1)
    value = F.floor(F.col("time") / hits).cast("bigint")
    rows = rows.withColumn("__b", F.when(hits > 0, bucket(value, conf.histogram))).withColumn("__w", F.greatest(hits, F.lit(0)))
    return rows.groupBy(*by, F.col("__b.cls").alias("cls"), F.col("__b.id").alias("id")).agg(F.sum("__w").cast("bigint").alias("cnt"), *sums)


def stream_ticks(source: Source, conf: ReportConf, late: str = "0 seconds", time_unit: str = "s") -> DataFrame:
    """Closed slices (tick, keys, measures, and buckets if the report has a histogram) of a streaming source of
    nested requests, in append mode."""
    s = Source(source.requests.withWatermark("ts", late).withColumn("slice", F.window("ts", f"{conf.tick_sec} seconds")))
    rows = _sliced(s, conf, time_unit, "slice")
    return rows.select(F.unix_seconds("slice.start").alias("tick"), *rows.columns[1:])


def _by_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("day", F.floor(F.col("tick") / 86400).cast("int"))


def write_ticks(ticks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start the query that appends closed slices to a parquet table partitioned by day."""
    return _by_day(ticks).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)


def read_ticks(spark: SparkSession, path: str) -> DataFrame | None:
    """The slice table; None as long as nothing was written."""
    try:
        t = spark.read.parquet(path)
        return t if "tick" in t.columns else None
    except AnalysisException:
        return None


def report_of(spark: SparkSession, path: str, conf: ReportConf, as_of: str | int) -> DataFrame:
    """The report of a slice table at a time (seconds since 1970, a timestamp's text, ``now``, or ``latest``: the
    newest closed slice is the window's last).  Only the window's days are read."""
    t = read_ticks(spark, path)
    if t is None:
        names = ", ".join(f"`{n}` string" for n in key_names(conf))
        more = ", cls int, id bigint, cnt bigint" if conf.histogram else ""
        t = spark.createDataFrame([], f"{names}{more}, {', '.join(f'{m} bigint' for m, _, _ in MEASURES[conf.kind])}, tick bigint, day int")
    tick = conf.tick_sec
    if isinstance(as_of, int):
        end = F.lit(as_of // tick * tick)
    elif as_of == "latest":
        # partition values alone give the newest day; its slices the newest tick
        last = t.agg(F.max("day").alias("d")).first()["d"]
        newest = t.where(F.col("day") == last).agg(F.max("tick")).first()[0] if last is not None else 0
        end = F.lit(newest + tick)
    else:
        end = F.floor(F.unix_timestamp(F.current_timestamp() if as_of == "now" else F.lit(as_of).cast("timestamp")) / tick) * tick
    day = F.col("day")
    t = t.where((day <= F.floor(end / 86400)) & (day >= F.floor((end - conf.window_sec) / 86400)))
    t = t.where((F.col("tick") < end) & (F.col("tick") >= end - conf.window_sec))
    return merged(t, conf, t.where(F.col("cls").isNotNull()) if conf.histogram else None)


def fan_out(requests: DataFrame, confs: dict[str, ReportConf], folder: str, checkpoint: str, trigger: dict | None = None, time_unit: str = "s"):
    """Feed many reports from one stream: each micro-batch is read and decoded once, kept, and sliced per report.

    Slices go to ``folder/name/batch=n``, replaced if a batch is repeated, so that nothing counts twice; slices of
    several batches add up.  A slice is closed as far as its reader's ``as_of`` is behind it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("tick", F.unix_seconds("ts"))
        batch.persist()
        try:
            for name, conf in confs.items():
                own = Source(batch.withColumn("tick", (F.floor(F.col("tick") / conf.tick_sec) * conf.tick_sec).cast("bigint")))
                _by_day(_sliced(own, conf, time_unit, "tick")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
