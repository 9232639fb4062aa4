"""spark.read.format("evtx"): events of log files on a file system that executors share."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import evtx

#: Chunks of one partition.
RUN = 64
SCHEMA = "source string, chunk int, off int, ts_ft bigint, written_ft bigint, record_id bigint, event_id int, level int, provider string, channel string, computer string, user_sid string, flags int, f map<string, array<string>>"


class Chunks(InputPartition):
    def __init__(self, path: str, header: int, first: int, last: int) -> None:
        self.path, self.header, self.first, self.last = path, header, first, last


class EvtxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.carve = str(options.get("carve", "true")).lower() == "true"

    def partitions(self) -> list[Chunks]:
        import os

        out = []
        for path in evtx.discover(self.paths):
            with open(path, "rb") as f:
                header = evtx.file_header(f.read(128)).header_size
            n = max(0, os.path.getsize(path) - header) // evtx.CHUNK
            out += [Chunks(path, header, k, min(n, k + RUN)) for k in range(0, n, RUN)]
        return out

    def read(self, partition: Chunks):
        with open(partition.path, "rb") as f:
            for k in range(partition.first, partition.last):
                f.seek(partition.header + k * evtx.CHUNK)
                for e in evtx.read_chunk(f.read(evtx.CHUNK), k, self.carve)[0]:
                    values: dict[str, list[str]] = {}
                    for name, value, _ in e["fields"]:
                        values.setdefault(name, []).append(value)
                    yield (partition.path, k, e["off"], e["ts_ft"], e["written_ft"], e["record_id"], e.get("event_id"), e.get("level"), e.get("provider"), e.get("channel"), e.get("computer"), e.get("user_sid"), e["flags"], values)


class EvtxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvtxReader:
        return EvtxReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(EvtxDataSource)
