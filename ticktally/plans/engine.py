"""The engine: a registry of reports that are visible as Spark SQL views, and its system tables."""

from __future__ import annotations

import logging
import re
import time
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counters import NAMES, counters, counters_of
from ..operators.report import report
from ..operators.source import Source
from ..operators.ticks import approx_rows
from ..sources import udp
from ..streaming.ticks import read_ticks, report_of, stream_ticks, write_ticks
from ..operators.filters import key_names
from .conf import ConfError, ReportConf, parse_report_conf

log = logging.getLogger("ticktally")

#: Columns of the system tables, in order (fixed values).
ACTIVE = (
    "id int", "table_name string", "internal_name string", "kind string", "uptime double", "time_window_sec int", "tick_count int", "approx_row_count bigint", "approx_mem_used bigint", "batches_sent bigint", "batches_received bigint",
    "packets_received bigint", "packets_lost bigint", "packets_aggregated bigint", "packets_dropped_by_bloom bigint", "packets_dropped_by_filters bigint", "packets_dropped_by_rfield bigint", "packets_dropped_by_rtag bigint", "packets_dropped_by_timertag bigint",
    "timers_scanned bigint", "timers_aggregated bigint", "timers_skipped_by_bloom bigint", "timers_skipped_by_filters bigint", "timers_skipped_by_tags bigint", "ru_utime double", "ru_stime double", "last_tick_time double", "last_tick_prepare_duration double", "last_snapshot_merge_duration double",
)
STATS = (
    "uptime double", "ru_utime double", "ru_stime double", "udp_poll_total bigint", "udp_recv_total bigint", "udp_recv_eagain bigint", "udp_recv_bytes bigint", "udp_recv_packets bigint", "udp_packet_decode_err bigint", "udp_batch_send_total bigint",
    "udp_batch_send_err bigint", "udp_packet_send_total bigint", "udp_packet_send_err bigint", "udp_ru_utime double", "udp_ru_stime double", "repacker_poll_total bigint", "repacker_recv_total bigint", "repacker_recv_eagain bigint", "repacker_recv_packets bigint",
    "repacker_packet_validate_err bigint", "repacker_batch_send_total bigint", "repacker_batch_send_by_timer bigint", "repacker_batch_send_by_size bigint", "repacker_ru_utime double", "repacker_ru_stime double", "coordinator_batches_received bigint",
    "coordinator_batch_send_total bigint", "coordinator_batch_send_err bigint", "coordinator_control_requests bigint", "coordinator_ru_utime double", "coordinator_ru_stime double", "dictionary_size bigint", "dictionary_mem_hash bigint", "dictionary_mem_list bigint",
    "dictionary_mem_strings bigint", "version_info string", "build_string string",
)
_EXTRA_AT = "version_info"  # SHOW STATUS has one more variable, "extra", before this one


@dataclass(frozen=True)
class EngineConfig:
    """Settings with their allowed ranges."""

    port: int = field(default=3002, metadata={"range": (0, 65536)})
    address: str = "*"
    log_level: str = "info"
    default_history_time_sec: int = field(default=60, metadata={"range": (10, 2**31 - 1)})
    udp_reader_threads: int = field(default=2, metadata={"range": (1, 16)})
    repacker_threads: int = field(default=2, metadata={"range": (1, 32)})
    repacker_input_buffer: int = field(default=512, metadata={"range": (128, 16384)})
    repacker_batch_messages: int = field(default=1024, metadata={"range": (128, 16384)})
    repacker_batch_timeout_ms: int = field(default=100, metadata={"range": (1, 1000)})
    coordinator_input_buffer: int = field(default=128, metadata={"range": (16, 1024)})
    report_input_buffer: int = field(default=128, metadata={"range": (16, 8192)})
    packet_debug: bool = False
    packet_debug_fraction: float = field(default=0.01, metadata={"range": (1e-9, 1.0)})
    time_filter_unit: str = "s"

    RUNTIME: ClassVar[tuple[str, ...]] = ("log_level", "packet_debug", "packet_debug_fraction")

    def __post_init__(self):
        for f in fields(self):
            if r := f.metadata.get("range"):
                if not r[0] <= getattr(self, f.name) <= r[1]:
                    raise ConfError(f"{f.name} must be within {r[0]} and {r[1]}")

    def variables(self) -> list[tuple[str, str]]:
        return [(f.name, str(getattr(self, f.name))) for f in fields(self)]


@dataclass
class Report:
    id: int
    name: str
    internal: str
    conf: ReportConf
    definition: str
    active_since: float
    merge_sec: float | None = None
    ticks: str | None = None  # folder of its slices, if a stream feeds it
    query: StreamingQuery | None = None


class Engine:
    """Reports over one source.  Names are views.

    A view holds the completed ticks of its report's window.  The window ends where ``clock`` says:
    ``latest``, after the tick with the newest request (tables at rest), or ``now`` (live sources).  A
    report counts as active from its creation on, since a view has no moment of first use.
    """

    def __init__(self, spark: SparkSession, source: Source, config: EngineConfig = EngineConfig(), clock: str = "latest"):
        self.spark, self.source, self.config, self.clock = spark, source, config, clock
        self.started = time.time()
        self._reports: dict[str, Report] = {}
        self._ids = 0
        self._control = 0

    def set_variable(self, name: str, value) -> None:
        if name not in EngineConfig.RUNTIME:
            raise ConfError(f"{name} can't be changed while running")
        self.config = replace(self.config, **{name: value})
        if name == "log_level":
            log.setLevel(str(value).upper())

    def create_report(self, name: str, definition: str) -> Report:
        """CREATE TABLE: parse, check, register and show as a view; all errors are raised here."""
        if name in self._reports:
            raise ConfError(f"report {name!r} exists")
        if not re.fullmatch(r"\w+", name):
            raise ConfError(f"bad report name {name!r}")
        conf = parse_report_conf(definition, self.config.default_history_time_sec)
        for w in conf.warnings:
            log.warning("%s: %s", name, w)
        self._ids += 1
        self._control += 1
        self._reports[name] = Report(self._ids, name, name, conf, definition, time.time())
        self._show(name)
        return self._reports[name]

    def _show(self, *names: str) -> None:
        """(Re)make views; those of the system tables follow every change."""
        system = [r.name for r in self._reports.values() if r.conf.kind in ("active", "stats")]
        for n in dict.fromkeys((*names, *system)):
            self.dataframe(n).createOrReplaceTempView(n)

    def feed(self, name: str, live: Source, folder: str, late: str = "0 seconds", trigger: dict | None = None) -> Report:
        """Let a stream of requests keep the report's slices in ``folder``; the view then reads them."""
        r = self._get(name)
        ticks = stream_ticks(live, r.conf, late, self.config.time_filter_unit)
        r.ticks, r.query = f"{folder}/ticks", write_ticks(ticks, f"{folder}/ticks", f"{folder}/checkpoint", trigger)
        return r

    def listen(self) -> DataFrame:
        """Datagrams of the UDP source with this engine's settings, as a stream."""
        udp.register(self.spark)
        c = self.config
        options = {"address": c.address, "port": c.port, "readers": c.udp_reader_threads, "batch_size": c.repacker_batch_messages, "batch_timeout_ms": c.repacker_batch_timeout_ms}
        return self.spark.readStream.format("udp_metrics").options(**{k: str(v) for k, v in options.items()}).load()

    def refresh(self, name: str) -> None:
        """Show what a stream has written so far."""
        self._show(name)

    def rename_report(self, old: str, new: str) -> None:
        """RENAME TABLE: the internal name stays."""
        if new in self._reports:
            raise ConfError(f"report {new!r} exists")
        r = self._get(old)
        del self._reports[old]
        r.name = new
        self._reports[new] = r
        self.spark.catalog.dropTempView(old)
        self._show(new)

    def drop_report(self, name: str) -> None:
        """DROP TABLE: the stream that feeds the report is stopped."""
        r = self._get(name)
        if r.query is not None:
            r.query.stop()
        del self._reports[name]
        self._control += 1
        self.spark.catalog.dropTempView(name)
        self._show()

    def alter_report(self, name: str, *_: object) -> None:
        raise ConfError("reports can't be altered; drop and create them")

    def insert(self, name: str, *_: object) -> None:
        raise ConfError("reports are read-only")

    def reports(self) -> list[Report]:
        return sorted(self._reports.values(), key=lambda r: r.id)

    def _get(self, name: str) -> Report:
        if name not in self._reports:
            raise ConfError(f"no report {name!r}")
        return self._reports[name]

    def dataframe(self, name: str, as_of: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The report; one DataFrame is one consistent plan."""
        r = self._get(name)
        if r.conf.kind == "active":
            return self.active()
        if r.conf.kind == "stats":
            return self.stats()
        if r.ticks:
            return report_of(self.spark, r.ticks, r.conf, as_of or self.clock)
        return report(self.source, r.conf, as_of or self.clock, self.config.time_filter_unit, columns=columns)

    def snapshot(self, name: str, as_of: str | None = None) -> DataFrame:
        """What the report holds at a time, cached for repeated reads."""
        r = self._get(name)
        began = time.time()
        df = self.dataframe(name, as_of).cache()
        r.merge_sec = time.time() - began
        return df

    def table_info(self, name: str) -> dict[str, object]:
        """What a planner is told of a report before it is read: few records, its columns, the plan's estimate of bytes."""
        df = self.dataframe(name)
        return {"records": 1 if self._get(name).conf.kind == "stats" else 2, "columns": df.columns, "bytes": self._bytes(df)}

    @staticmethod
    def _bytes(df: DataFrame) -> int:
        return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 2**63 - 1)

    def dump(self, name: str, as_of: str | None = None) -> DataFrame:
        """The report as JSON text, a row a line."""
        return self.dataframe(name, as_of).select(F.to_json(F.struct("*")).alias("line"))

    def state(self, name: str) -> DataFrame:
        """The report's counters."""
        return counters(self.source, self._get(name).conf, self.config.time_filter_unit)

    def active(self) -> DataFrame:
        """One row per report: identity, window, counters; all reports are counted in one pass over the source."""
        own = {r.name: r for r in self.reports() if r.conf.kind not in ("active", "stats")}
        if not own:
            return self.spark.createDataFrame([], ", ".join(ACTIVE))
        known = [(r.name, r.id, r.internal, r.conf.kind, r.active_since, r.conf.window_sec, r.conf.tick_count, r.merge_sec, self._bytes(self.dataframe(r.name))) for r in own.values()]
        about = self.spark.createDataFrame(known, "name string, id int, internal_name string, kind string, since double, time_window_sec int, tick_count int, merge_sec double, approx_mem_used bigint")
        for r in own.values():
            if r.ticks and (ticks := read_ticks(self.spark, r.ticks)) is not None:
                rows = approx_rows(ticks, key_names(r.conf)).select(F.lit(r.name).alias("name"), "approx_row_count")
                about = about.join(F.broadcast(rows), "name", "left") if "approx_row_count" not in about.columns else about.join(F.broadcast(rows.withColumnRenamed("approx_row_count", "__more")), "name", "left").withColumn("approx_row_count", F.coalesce("approx_row_count", "__more")).drop("__more")
        rows = about.join(F.broadcast(counters_of(self.source, {n: r.conf for n, r in own.items()}, self.config.time_filter_unit)), "name")  # one row per report
        batches = {n: F.lit(self._batches(r)) for n, r in own.items()}
        seen = F.coalesce(*[F.when(F.col("name") == n, c) for n, c in batches.items()])
        known_as = {"table_name": F.col("name"), "uptime": F.unix_micros(F.current_timestamp()) / 1e6 - F.col("since"), "batches_sent": seen, "batches_received": seen, "packets_lost": F.lit(0), "last_snapshot_merge_duration": F.col("merge_sec")}
        return rows.select(*[(known_as.get(n) if n in known_as else F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ACTIVE)])

    @staticmethod
    def _batches(r: Report) -> int:
        last = r.query.lastProgress if r.query is not None else None
        return int(last["batchId"]) + 1 if last else 0

    def stats(self, progress: dict | None = None, decode: DataFrame | None = None) -> DataFrame:
        """One row; ``progress`` is a streaming query's last progress, ``decode`` the outcome counts of its datagrams.
        What Spark has no counterpart for is null."""
        known: dict[str, object] = {"coordinator_control_requests": self._control, "version_info": self.spark.version, "build_string": f"spark {self.spark.version}"}
        if progress:
            known |= {"udp_recv_packets": int(progress.get("numInputRows", 0)), "udp_batch_send_total": int(progress.get("batchId", 0)) + 1, "coordinator_batches_received": int(progress.get("batchId", 0)) + 1}
        if decode is not None:
            by = {r["result"]: r["packets"] for r in decode.collect()}  # one row per outcome
            known |= {"udp_packet_decode_err": by.get("packet_decode_err", 0), "repacker_packet_validate_err": sum(n for k, n in by.items() if k not in ("okay", "packet_decode_err")), "repacker_recv_packets": sum(by.values())}
        row = self.spark.createDataFrame([tuple(known.get(c.split()[0]) for c in STATS)], ", ".join(STATS))
        return row.withColumn("uptime", F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(self.started))

    def status(self, prefix: str = "Ticktally_") -> DataFrame:
        """SHOW STATUS: (Variable_name, Value) of the statistics."""
        s = self.stats()
        names = [c.split()[0] for c in STATS]
        at = names.index(_EXTRA_AT)
        s = s.withColumn("extra", F.lit(""))
        return s.select(*[F.col(n).cast("string").alias(prefix + n) for n in (*names[:at], "extra", *names[at:])]).unpivot([], [prefix + n for n in (*names[:at], "extra", *names[at:])], "Variable_name", "Value")

    def debug_packets(self, fraction: float | None = None) -> DataFrame:
        """A sample of requests as JSON text, for the log."""
        f = self.config.packet_debug_fraction if fraction is None else fraction
        return self.source.nested().sample(f, seed=1).select(F.to_json(F.struct("*")).alias("packet"))
