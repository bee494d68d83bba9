"""Streaming source of framed values from a TCP socket.

``spark.readStream.format("sparkseries_socket").schema(...).option("host", ...).option("port", ...)``.
Frames are four-byte big-endian lengths and values, as ``wire.frames`` writes
them.  A socket cannot be read twice, so rows are at most once after a restart;
use files where that matters.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..plans.scratch import ship_package
from . import wire
from .datasource import rows_of, to_spark


class _SocketReader(SimpleDataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.wait, self.most = schema, float(options.get("wait", "0.2")), int(options.get("max_frames", "1000"))
        self.address = (options.get("host", "localhost"), int(options["port"]))
        self.link: socket.socket | None = None
        self.buffer, self.kept = b"", {}

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def _frames(self) -> list:
        """What has arrived, whole frames only."""
        if self.link is None:
            self.link = socket.create_connection(self.address, timeout=5)
        self.link.settimeout(self.wait)
        try:
            while part := self.link.recv(1 << 16):
                self.buffer += part
                if len(self.buffer) > 1 << 24:
                    break
        except TimeoutError:
            pass
        out = []
        while len(out) < self.most and len(self.buffer) >= 4:
            n = struct.unpack_from(">I", self.buffer)[0]
            if len(self.buffer) < 4 + n:
                break
            out.append(self.buffer[4 : 4 + n])
            self.buffer = self.buffer[4 + n :]
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._frames()
        rows = [tuple(to_spark(r.get(f.name), f.dataType) for f in self.schema) for d in found for r in rows_of(iter([wire.decode(d)]))]
        self.kept[start["frames"]] = rows
        return iter(rows), {"frames": start["frames"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.kept.get(start["frames"], []))

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["frames"]}


class SocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkseries_socket"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _SocketReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(SocketSource)
