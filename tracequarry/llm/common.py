"""What the training-data operators share: words, hashes, shared-folder tables and connected components.

Words come from ``bytes.split()``: it splits UTF-8 at bytes 0x20 and 0x09-0x0D, which is exactly the
class ``[^\\x20\\x09-\\x0D]+``, as no byte of a longer UTF-8 sequence is below 0x80.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold; Spark bounds its bytes itself (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
BATCH_ROWS = 1000
#: Entries of a worker's word cache before it starts anew; it saves time only.
CACHE_WORDS = 400_000
#: Whether Spark deletes a query's shuffle files at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or our own where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        given = f"file://{tempfile.mkdtemp(prefix='stages-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors.

    Spark deletes the shuffle files of the write when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what came of them is stored itself.

    Then the driver lets go of ended plans and their broadcasts: its heap grows with many short jobs otherwise, as nothing in it makes room.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        spark.sparkContext._jvm.System.gc()


def kept_names(df: DataFrame, keep: tuple[str, ...], own: list[str]) -> tuple[list[str], str]:
    """Output names of kept columns and their part of a schema. A name that an operator's own column bears gets ``_in``."""
    taken, names = {x.lower() for x in own}, []
    for c in keep:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        names.append(c)
    kinds = [df.select(F.col(f"`{c}`")).schema[0].dataType.simpleString() for c in keep]
    return names, "".join(f"`{c}` {k}, " for c, k in zip(names, kinds, strict=True))


def fields(schema: str) -> list[str]:
    """Names of a flat schema in text."""
    return [x.split()[0] for x in schema.split(", ")]


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, kept while the worker sees it again."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_B
    return h ^ (h >> np.uint64(33))


def odd_weights(n: int, seed: int = 0x5BD1E995) -> np.ndarray:
    """n odd 64-bit weights, the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def rolling(h: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """A hash of each run of n consecutive word hashes, in order of their start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += h[k : k + m] * weights[k]
    return mixed(out)


def list_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), type=kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, root), root the smallest node.

    Each round points every node to its smallest neighbour, follows the pointers to their ends and
    contracts the edges; a round at least halves the nodes of each component that still has edges, so
    rounds grow with the logarithm of the largest one. Only edges between roots stay, in the shared folder,
    and nothing but a count comes to the driver. Empty edges give an empty result.
    """
    live = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    mapping = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(parent.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.coalesce("top", "root") != F.col("root")).alias("moved")), "parents")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            mapping = stored(mapping.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        pa_, pb_ = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stored(live.join(pa_, "a").join(pb_, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return mapping if mapping is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) of more edges (a, b) beside those that roots came of: only roots and what the edges add are walked."""
    top = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = edges.join(top("a"), "a", "left").join(top("b"), "b", "left")
    step = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    known = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(known.union(step.join(roots, "node", "left_anti").select("node", "root")), "roots")


def batches(run) -> object:
    """Wrap a function of one record batch for mapInArrow, with state made once for each task."""

    def mapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = run()
        for batch in it:
            if batch.num_rows:
                yield from step(batch)

    return mapped
