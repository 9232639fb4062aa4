"""Build a case from event log files: parse chunks in parallel, order, merge copies, number, write Parquet."""

from __future__ import annotations

import hashlib
import json
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timeparse import timestamp
from ..model import BIT, EVENTS, flag_names, numbered
from ..operators.progress import Progress
from . import evtx
from . import files as files_of


@dataclass(frozen=True)
class Options:
    carve: bool = True
    hash_sources: bool = True
    merge_copies: bool = True


def unique_labels(paths: list[str]) -> dict[str, str]:
    """The shortest path suffix that tells each source from the others."""
    parts = {p: p.replace("\\", "/").split("/") for p in paths}
    out = {}
    for p, own in parts.items():
        n = 1
        while n < len(own) and sum(other[-n:] == own[-n:] for other in parts.values()) > 1:
            n += 1
        out[p] = "/".join(own[-n:])
    return out


_CHUNKS = "path string, size bigint, sha256 string, header int, version string, chunks int, failure string, tail bigint, chunk int, data binary"


def chunks(spark: SparkSession, paths: list[str], hash_sources: bool = True) -> DataFrame:
    """Every physical chunk of every file; a file that is no log is one row with its failure."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                sha = hashlib.sha256(data).hexdigest() if hash_sources else None
                head = {"path": path, "size": len(data), "sha256": sha}
                try:
                    header = evtx.file_header(bytes(data[:128]))
                except evtx.NotALog as e:
                    yield _batch([head | {"failure": str(e)}])
                    continue
                body = len(data) - header.header_size
                head |= {"header": header.crc_ok | header.dirty << 1 | header.full << 2, "version": f"{header.major}.{header.minor}", "chunks": header.chunks, "tail": max(0, body) % evtx.CHUNK}
                if body < evtx.CHUNK:
                    yield _batch([head])
                for k in range(max(0, body) // evtx.CHUNK):
                    at = header.header_size + k * evtx.CHUNK
                    yield _batch([head | {"chunk": k, "data": bytes(data[at : at + evtx.CHUNK])}])

    schema = [("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("header", pa.int32()), ("version", pa.string()), ("chunks", pa.int32()), ("failure", pa.string()), ("tail", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())]

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in schema], names=[n for n, _ in schema])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(split, _CHUNKS)


def template_library(rows: DataFrame) -> dict[int, object]:
    """Templates by id over all chunks; programs have a few thousand templates however many events they write."""

    def collect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data in batch.column(0).to_pylist():
                try:
                    found = evtx.Chunk.read(data).load_templates()
                except (struct.error, IndexError):
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([pickle.dumps(t) for t in found.values()], pa.binary())], names=["id", "template"])

    got = rows.where("data is not null").select("data").mapInArrow(collect, "id bigint, template binary").groupBy("id").agg(F.max("template").alias("template"))
    return {r["id"]: pickle.loads(bytes(r["template"])) for r in got.toLocalIterator()}


_PARSED = (
    "kind string, path string, chunk int, off int, ts_ft bigint, written_ft bigint, record_id bigint, event_id int, qualifiers int, version smallint, level smallint, task int, opcode smallint, keywords bigint, provider string, channel string,"
    " computer string, user_sid string, pid bigint, tid bigint, flags int, fields array<struct<name: string, value: string, type: smallint>>, f map<string, array<string>>, xml string, valid boolean, empty boolean, last_id bigint, live int, carved int"
)
_FIELD = pa.struct([("name", pa.string()), ("value", pa.string()), ("type", pa.int16())])
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "boolean": pa.bool_()}


def _columns() -> list[tuple[str, pa.DataType]]:
    out = []
    for f in _PARSED.replace(" array<struct<name: string, value: string, type: smallint>>", " fieldlist").replace(" map<string, array<string>>", " fieldmap").split(","):
        name, kind = f.split()
        out.append((name, {"fieldlist": pa.list_(_FIELD), "fieldmap": pa.map_(pa.string(), pa.list_(pa.string()))}.get(kind) or _ARROW[kind]))
    return out


def parse(rows: DataFrame, carve: bool = True) -> DataFrame:
    """Rows of kind event and of kind chunk. Chunks are spread over tasks; templates of all chunks are known to each."""
    spark = rows.sparkSession
    library = spark.sparkContext.broadcast(template_library(rows))
    columns = _columns()
    wide = {"event_id": 32, "qualifiers": 32, "task": 32}

    def fit(name: str, v):
        if v is None or name not in wide and name not in ("version", "level", "opcode"):
            return v
        bits = wide.get(name, 16)
        return v if -(1 << bits - 1) <= v < 1 << bits - 1 else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, index, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                events, summary = evtx.read_chunk(data, index, carve, library.value)
                out = [summary | {"kind": "chunk", "path": path}]
                for e in events:
                    grouped: dict[str, list[str]] = {}
                    for n, v, _ in e["fields"]:
                        grouped.setdefault(n, []).append(v)
                    fields = [{"name": n, "value": v, "type": t} for n, v, t in e["fields"]]
                    out.append(e | {"kind": "event", "path": path, "fields": fields, "f": list(grouped.items())})
                yield pa.RecordBatch.from_arrays([pa.array([fit(n, r.get(n)) for r in out], k) for n, k in columns], names=[n for n, _ in columns])

    spread = rows.where("data is not null").select("path", "chunk", "data").repartition(F.xxhash64("path", "chunk"))
    return spread.mapInArrow(run, _PARSED)


def position_flags(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Events with beyondHeader, and stale where a chunk beyond the header's count holds nothing newer than the live ones."""
    spots = parsed.where("kind = 'chunk'").select("path", "chunk", "last_id").join(files.select("path", "chunks").distinct(), "path").withColumn("beyond", F.col("chunk") >= F.col("chunks"))
    live = spots.where("not beyond").groupBy("path").agg(F.max("last_id").alias("live_id"))
    spots = spots.where("beyond").join(live, "path", "left")
    extra = F.lit(BIT["beyondHeader"]).bitwiseOR(F.when(F.col("last_id") <= F.coalesce("live_id", F.lit(-1)), BIT["stale"]).otherwise(0))
    marks = spots.select("path", "chunk", extra.alias("_extra"))
    return parsed.where("kind = 'event'").join(marks, ["path", "chunk"], "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_extra", F.lit(0)))).drop("_extra")


ORDER = ("ts_ft", "_computer", "_channel", "record_id", "event_id", "_carved", "source_id", "chunk", "off")


def merge_copies(events: DataFrame, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, copies): of records that agree in time, computer, channel, record and event id the first in ORDER stays."""
    rows = events.withColumns({"_computer": F.coalesce(F.lower("computer"), F.lit("")), "_channel": F.coalesce(F.lower("channel"), F.lit("")), "_carved": F.col("flags").bitwiseAND(F.lit(BIT["carved"])) != 0})
    if not merge:
        return rows, rows.limit(0)
    same = Window.partitionBy("ts_ft", "_computer", "_channel", "record_id", "event_id")
    rows = rows.withColumn("_n", F.row_number().over(same.orderBy("_carved", "source_id", "chunk", "off"))).withColumn("_many", F.count("*").over(same))
    first = rows.where("_n = 1").withColumn("flags", F.when(F.col("_many") > 1, F.col("flags").bitwiseOR(F.lit(BIT["hasCopies"]))).otherwise(F.col("flags")))
    return first.drop("_n", "_many"), rows.where("_n > 1").drop("_n", "_many")


def build(spark: SparkSession, inputs: list[str], case: str, options: Options = Options(), progress: Progress | None = None) -> dict:
    """Write a new case folder and return its manifest. A case that exists is refused; one that fails or is cancelled is removed."""
    if _exists(spark, case):
        raise FileExistsError(case)
    try:
        return _build(spark, inputs, case, options, progress or Progress(spark))
    except BaseException:
        _remove(spark, case)
        raise


def _build(spark: SparkSession, inputs: list[str], case: str, options: Options, progress: Progress) -> dict:
    with progress.phase("scanning"):
        paths = files_of.discover(spark, inputs)
        labels = unique_labels(paths)
        own = spark.createDataFrame([(p, i, labels[p]) for i, p in enumerate(paths)], "path string, source_id int, source string")
        found = chunks(spark, paths, options.hash_sources)
        found.drop("data", "chunk").distinct().write.parquet(f"{case}/_files")
        files = spark.read.parquet(f"{case}/_files")
    with progress.phase("parsing"):
        parse(found, options.carve).write.parquet(f"{case}/_parsed")
        parsed = spark.read.parquet(f"{case}/_parsed")
    with progress.phase("sorting"):
        events = position_flags(parsed, files).join(own, "path")
        first, copies = merge_copies(events, options.merge_copies)
        dense = numbered(first, list(ORDER))
        dense = dense.withColumn("ts", timestamp(F.col("ts_ft"))).withColumn("event_date", F.to_date("ts"))
    with progress.phase("writing"):
        dense.select(*EVENTS).sortWithinPartitions("event_date", "id").write.partitionBy("event_date").parquet(f"{case}/events")
        stored = spark.read.parquet(f"{case}/events")
    with progress.phase("finishing"):
        same = ["ts_ft", "record_id", "event_id"]
        keyed = stored.withColumns({"_computer": F.coalesce(F.lower("computer"), F.lit("")), "_channel": F.coalesce(F.lower("channel"), F.lit(""))})
        dups = copies.alias("c").join(keyed.select(F.col("id").alias("ev"), "_computer", "_channel", *same).alias("e"), [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*same, "_computer", "_channel"]])
        dups.select("ev", F.col("c.source_id").alias("src"), "c.chunk", "c.off", "c.flags").write.parquet(f"{case}/dups")
        source_stats(parsed, files, own, copies).write.parquet(f"{case}/sources")
        events.where("xml is not null").select("source_id", "chunk", "off", "xml").write.parquet(f"{case}/xml")
        catalog(stored).write.parquet(f"{case}/field_catalog")
        stats = stored.agg(F.count("*").alias("events"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft")).first()
        failed = [r.asDict() for r in files.where("failure is not null").select("path", "failure").collect()]
        manifest = {"format": 1, "events": stats["events"], "first_ft": stats["first_ft"], "last_ft": stats["last_ft"], "files": len(paths), "failed": failed, "options": vars(options)}
        for part in ("_files", "_parsed"):
            _remove(spark, f"{case}/{part}")
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{case}/manifest")
    return manifest


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = files_of.opened(spark, path)
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = files_of.opened(spark, path)
    fs.delete(p, True)


def catalog(events: DataFrame) -> DataFrame:
    """name, n_events, n_values, max_mult of each field."""
    each = events.select(F.explode("f").alias("name", "values")).select("name", F.size("values").alias("n"))
    return each.groupBy("name").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_values"), F.max("n").alias("max_mult")).withColumn("is_system", F.lit(False))


def source_stats(parsed: DataFrame, files: DataFrame, own: DataFrame, copies: DataFrame) -> DataFrame:
    """Per source: records, carved, copies, first and last time, and the health of its chunks."""
    flags = F.col("flags")
    bit = lambda n: flags.bitwiseAND(F.lit(BIT[n])) != 0
    events = parsed.where("kind = 'event'").groupBy("path").agg(F.count("*").alias("records"), F.count_if(bit("carved")).alias("carved"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft"))
    chunk = parsed.where("kind = 'chunk'").join(files.select("path", "chunks").distinct(), "path").withColumn("beyond", F.col("chunk") >= F.col("chunks"))
    live = chunk.where("not beyond").groupBy("path").agg(F.max("last_id").alias("live_id"))
    chunk = chunk.join(live, "path", "left").withColumns({"beyond": F.col("beyond") & F.col("valid") & (F.col("live") > 0), "stale": F.col("last_id") <= F.coalesce("live_id", F.lit(-1))})
    spots = chunk.groupBy("path").agg(
        F.count("*").alias("physical_chunks"), F.count_if(~F.col("valid")).alias("empty_chunks"), F.count_if(F.col("beyond") & ~F.col("stale")).alias("beyond_new"), F.count_if(F.col("beyond") & F.col("stale")).alias("beyond_stale"),
        F.count_if(F.col("valid") & bit("headerCrcMismatch")).alias("header_crc_chunks"), F.count_if(F.col("valid") & bit("crcMismatch")).alias("data_crc_chunks"),
    )
    merged = copies.groupBy("path").agg(F.count("*").alias("copies"))
    out = own.join(files, "path", "left").join(events, "path", "left").join(spots, "path", "left").join(merged, "path", "left")
    counts = ("records", "carved", "physical_chunks", "empty_chunks", "beyond_new", "beyond_stale", "header_crc_chunks", "data_crc_chunks", "copies")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def flag_counts(events: DataFrame) -> DataFrame:
    return events.select("source", F.explode(flag_names(F.col("flags"))).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("count"))
