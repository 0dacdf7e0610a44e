"""Sources of raw messages: recordings, a folder that tests drop packets in, and datagrams.

`reader(spark, kind, ...)` picks one by name. Kinds that stand for hardware (a pool of completion buffers, a kernel-bypass ring) are datagram
sources with a bounded pool: what doesn't fit is dropped and counted, and long packets are cut.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

PACKETS = "payload string, t1_ns long"


class NotConnected(RuntimeError):
    """A transport that is not active was asked for packets."""


def recording(spark: SparkSession, path: str) -> DataFrame:
    """(connection, ord, payload) of files with one message a line; a file is a connection, and `ord` ascends in it in the order of its lines."""
    lines = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("connection"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("payload"))
    firsts = lines.groupBy("connection", "block").agg(F.min("place").alias("first"))  # a block is read in order by one task, and has fewer lines than bytes
    return lines.join(firsts, ["connection", "block"]).filter("payload <> ''").select("connection", (F.col("block") + F.col("place") - F.col("first")).alias("ord"), "payload")


class Drop:
    """Packets for tests: `push` files them, `frame` reads all as a batch, `stream` in batches of `most` files, in the order of their arrival."""

    def __init__(self, folder: str):
        self.folder, self.pushed, self.active = Path(folder), 0, True
        self.folder.mkdir(parents=True, exist_ok=True)

    def push(self, payload: str, t1_ns: int) -> None:
        held = self.folder / f".{self.pushed}"
        held.write_text(json.dumps({"ord": self.pushed, "payload": payload, "t1_ns": t1_ns}) + "\n")
        held.rename(self.folder / f"{self.pushed:012}.json")
        self.pushed += 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return self._checked(spark).schema(f"ord long, {PACKETS}").json(str(self.folder))

    def stream(self, spark: SparkSession, most: int = 1000) -> DataFrame:
        self._checked(spark)
        return spark.readStream.schema(f"ord long, {PACKETS}").option("maxFilesPerTrigger", most).json(str(self.folder))

    def _checked(self, spark: SparkSession):  # noqa: ANN202
        if not self.active:
            raise NotConnected(str(self.folder))
        return spark.read


class DatagramReader(SimpleDataSourceStreamReader):
    """At most `batch` datagrams each time, until none waits. Of what waits, `pool` fit in buffers of `entry` bytes; the rest is dropped and counted."""

    def __init__(self, options: dict):
        self.batch, self.pool, self.entry = int(options.get("batch", 64)), int(options.get("pool", 1 << 30)), int(options.get("entry", 65535))
        self.address, self.socket = (options.get("host", "127.0.0.1"), int(options["port"])), None
        self.held: dict[int, list[tuple]] = {}

    def bound(self) -> socket.socket:
        """The socket, bound when the stream first reads: plans are made of readers that never do."""
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        return self.socket

    def initialOffset(self) -> dict:  # noqa: N802
        return {"packets": 0, "bytes": 0, "polls": 0, "empty_polls": 0, "overruns": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, overruns = [], 0
        while len(rows) + overruns < self.batch:
            try:
                data, _ = self.bound().recvfrom(65535)
            except BlockingIOError:
                break
            if len(rows) < self.pool:
                rows.append((data[: self.entry].decode("utf-8", "replace"), time.time_ns()))
            else:
                overruns += 1
        size = sum(len(r[0].encode()) for r in rows)
        end = {"packets": start["packets"] + len(rows), "bytes": start["bytes"] + size, "polls": start["polls"] + 1, "empty_polls": start["empty_polls"] + (not rows), "overruns": start["overruns"] + overruns}
        self.held[start["polls"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for k in range(start["polls"], end["polls"]) for r in self.held.get(k, [])])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.held if k < end["polls"]]:
            del self.held[k]


class DatagramSource(DataSource):
    """`spark.readStream.format("tickforge_datagrams")`: options host, port, batch, pool, entry. The counters are in the stream's offsets."""

    @classmethod
    def name(cls) -> str:
        return "tickforge_datagrams"

    def schema(self) -> str:
        return PACKETS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return DatagramReader(self.options)


#: Options of each kind of datagram source: plain sockets, completion buffers, kernel-bypass rings.
KINDS = {"socket": {}, "completion": {"pool": 256, "entry": 2048}, "bypass": {"pool": 512, "entry": 2048}}
#: The kinds that a tier may use, best first.
TIERS = {1: ["bypass", "completion", "socket"], 2: ["completion", "socket"], 3: ["socket"]}


def reader(spark: SparkSession, kind: str, **options: object) -> DataFrame:
    """A stream of packets of `kind`: `folder` with option path, or a datagram kind with option port."""
    if kind == "folder":
        return Drop(str(options["path"])).stream(spark, int(str(options.get("batch", 1000))))
    if kind not in KINDS:
        raise ValueError(f"no transport {kind!r}: folder, {', '.join(KINDS)}")
    spark.dataSource.register(DatagramSource)
    return spark.readStream.format(DatagramSource.name()).options(**{k: str(v) for k, v in (KINDS[kind] | options).items()}).load()


def best(tier: int, available: set[str]) -> str:
    """The best kind of a tier that is available; sockets always are."""
    return next(k for k in TIERS[tier] if k in available or k == "socket")
