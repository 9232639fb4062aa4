"""Files on whatever store Spark reads: listing, first bytes and single ranges through the Hadoop file system."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import evtx


def opened(spark: SparkSession, path: str):
    """(file system, path) of a path or URI."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discover(spark: SparkSession, inputs: list[str]) -> list[str]:
    """Files as given; folders recursively for *.evtx and for files without an extension that start as logs do.

    Hidden files, hidden folders and links are left out. Listing reads no file; the first bytes of files without an extension
    are read by tasks.
    """
    named, maybe = [], []
    for given in inputs:
        fs, top = opened(spark, given)
        if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
            named.append(str(fs.makeQualified(top)))
            continue
        todo = [top]
        while todo:
            for status in fs.listStatus(todo.pop()):
                p = status.getPath()
                name = p.getName()
                if name.startswith(".") or status.isSymlink():
                    continue
                if status.isDirectory():
                    todo.append(p)
                elif name.lower().endswith(".evtx"):
                    named.append(str(p))
                elif "." not in name:
                    maybe.append(str(p))
    if maybe:
        starts = spark.read.format("binaryFile").load(maybe).select("path", F.substring("content", 1, len(evtx.MAGIC)).alias("start"))
        named += [r["path"] for r in starts.where(F.col("start") == F.lit(evtx.MAGIC)).select("path").collect()]
    return sorted(dict.fromkeys(named))


def part(spark: SparkSession, path: str, at: int, size: int) -> bytes:
    """Up to so many bytes of a file from a place on."""
    fs, p = opened(spark, path)
    stream = fs.open(p)
    try:
        left = max(0, fs.getFileStatus(p).getLen() - at)
        stream.seek(at)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, left)))
    finally:
        stream.close()


def reread(spark: SparkSession, path: str, chunk: int | None, off: int | None, record_id: int | None) -> tuple[str, bytes | None]:
    """A record from its source file again: (state, bytes). States: loaded, missing, no-access, unreadable, mismatch, no-location."""
    if chunk is None or off is None:
        return "no-location", None
    try:
        head = evtx.file_header(part(spark, path, 0, 128))
        data = part(spark, path, head.header_size + chunk * evtx.CHUNK, evtx.CHUNK)
    except Py4JJavaError as e:
        kind, text = e.java_exception.getClass().getSimpleName(), str(e.java_exception.getMessage())
        if "Permission denied" in text or kind == "AccessControlException":
            return "no-access", None
        return ("missing" if kind in ("FileNotFoundException", "NoSuchFileException") else "unreadable"), None
    except evtx.NotALog:
        return "unreadable", None
    return evtx.record_again(data, off, record_id)
