"""UDP as a streaming source.  Datagrams can't be read again: delivery is at most once; for a durable
pipeline let a log (files, Kafka) take the datagrams and read that.

With ``readers`` of 1 one socket on the driver takes them.  With more, every micro-batch has that many
tasks, each with a socket of its own on the same port, among which the system spreads the datagrams;
sockets stay open in the executors' Python workers, so that they gather datagrams between batches too.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .wire import LIMIT


_SOCKETS: dict[tuple, socket.socket] = {}  # of this process, open from their first use on


def opened(address: str, port: int) -> socket.socket:
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    if hasattr(socket, "SO_REUSEPORT"):
        s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEPORT, 1)
    s.bind(("" if address == "*" else address, port))
    s.setblocking(False)
    return s


class UdpReaders(DataSourceStreamReader):
    """Several readers on the executors; an offset is the number of micro-batches so far."""

    def __init__(self, options: dict):
        self.readers = int(options.get("readers", 1))
        self.size, self.wait = int(options.get("batch_size", 1024)), int(options.get("batch_timeout_ms", 100)) / 1000
        self.address, self.port = options.get("address", "*"), int(options.get("port", 3002))
        self.batches = 0

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        self.batches += 1
        return {"batches": self.batches}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((end["batches"], i)) for i in range(self.readers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        batch, reader = partition.value
        sock = _SOCKETS.get((self.address, self.port))
        if sock is None:
            sock = _SOCKETS[self.address, self.port] = opened(self.address, self.port)
        until, n = time.monotonic() + self.wait, 0
        while n < self.size and time.monotonic() < until:
            try:
                row = ((batch << 32) + (reader << 20) + n, time.time_ns() // 1000, sock.recv(LIMIT))
            except BlockingIOError:
                time.sleep(0.002)
            else:
                n += 1
                yield row

    def commit(self, end: dict) -> None:
        pass


class UdpReader(SimpleDataSourceStreamReader):
    """Takes what has arrived, up to ``batch_size`` datagrams or ``batch_timeout_ms``."""

    def __init__(self, options: dict):
        self.size = int(options.get("batch_size", 1024))
        self.wait = int(options.get("batch_timeout_ms", 100)) / 1000
        self.address, self.port = options.get("address", "*"), int(options.get("port", 3002))
        self._sock: socket.socket | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sock": None}  # readers are sent to the process that runs them

    @property
    def sock(self) -> socket.socket:
        """Opened where it is first used."""
        if self._sock is None:
            self._sock = opened(self.address, self.port)
        return self._sock

    def initialOffset(self) -> dict:
        return {"packets": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got: list[tuple] = []
        until = time.monotonic() + self.wait
        while len(got) < self.size and time.monotonic() < until:
            try:
                got.append((start["packets"] + len(got), time.time_ns() // 1000, self.sock.recv(LIMIT)))
            except BlockingIOError:
                time.sleep(0.002)
        return iter(got), {"packets": start["packets"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(())  # lost: nothing can be read again

    def commit(self, end: dict) -> None:
        pass


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp_metrics"

    def schema(self) -> str:
        return "packet_no bigint, received_us bigint, datagram binary"

    def streamReader(self, schema: StructType) -> UdpReaders:
        if int(self.options.get("readers", 1)) == 1:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader of one reader"})
        return UdpReaders(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> UdpReader:
        return UdpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpSource)
