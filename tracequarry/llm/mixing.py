"""Mixing sources to target weights.

Words are packed into blocks of BLOCK words per source; the mix is a run of slots dealt to output shards. Each source's
slots are spread over the shards by a multinomial draw that meets the source's quota: the shards are halved again and
again, and a seeded binomial draw at each node says how many slots go left. Any range of a source's slots thus knows its
shards without the others. Slots of a source go through a pseudorandom permutation of its blocks, a new one for each pass,
and are joined with the blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK = 64
SHARD_SLOTS = 65_536
#: Documents of one cell, within which word offsets are summed in order.
CELL_DOCS = 4096
SEED = 20_240_611
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources from rows (source, source_size): adds src (0, 1, ... by code point, null last), weight and target.

    A target is weight times one common level, but at most ``most`` times the source's size; the level
    makes them add up to share times all sizes. One row per source, so one task orders them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("src", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "src")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * float(share) - before) / rest
    rows = rows.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(chosen * F.col("weight"), F.col("cap")))).select("source", "source_size", "src", "weight", "target")


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The i-th of 0..n-1 in a pseudorandom order: a four-round Feistel network on the next even number of bits, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = common.mixed(np.arange(4, dtype=np.uint64) + np.uint64(seed & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            a, b = b, a ^ (common.mixed(b + k) & low)
        return a << np.uint64(half) | b

    out = once(i.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def spread(first: int, end: int, quota: int, shards: int, seed: list[int]) -> list[tuple[int, int, int]]:
    """(shard, first, end) of the parts of a source's slots first to end, of quota in all, over shards.

    A node of the halving tree draws from the binomial distribution with its place in the tree as seed, so that every caller
    sees the same counts; nodes outside the range are not visited.
    """
    out, todo = [], [(0, shards, 0, quota)]
    while todo:
        lo, hi, at, n = todo.pop()
        if at >= end or at + n <= first or not n:
            continue
        if hi - lo == 1:
            out.append((lo, max(at, first), min(at + n, end)))
            continue
        mid = (lo + hi) // 2
        left = int(np.random.default_rng([*seed, lo, hi]).binomial(n, (mid - lo) / (hi - lo)))
        todo += [(mid, hi, at + left, n - left), (lo, mid, at, left)]
    return out


def slots(recipe: DataFrame, shards: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: shard, src, pass (0 for the first time around), block, most (words that the slot takes).

    recipe: src, blocks, turns (whole passes) and rest (words of the last pass) of each source; its slots are made in
    ranges of SHARD_SLOTS. Nothing here depends on partitioning, so reruns agree.
    """
    quota = F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / block)
    ranges = recipe.withColumn("quota", quota.cast("long")).where("quota > 0")
    ranges = ranges.select("src", "blocks", "turns", "rest", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(SHARD_SLOTS).cast("long"))).alias("first"))
    parts = max(1, recipe.sparkSession.sparkContext.defaultParallelism * 4)

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for src, blocks, turns, rest, quota, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                j = np.arange(first, min(first + SHARD_SLOTS, quota))
                turn, place, most = j // blocks, np.empty(len(j), np.int64), np.full(len(j), block, np.int64)
                for t in np.unique(turn).tolist():
                    place[turn == t] = permuted(j[turn == t] % blocks, blocks, seed + 1_000_003 * src + t)
                if rest and j[-1] == quota - 1:
                    most[-1] = rest - (quota - 1 - turns * blocks) * block
                shard = np.empty(len(j), np.int64)
                for k, a, b in spread(first, first + len(j), quota, shards, [seed, src]):
                    shard[a - first : b - first] = k
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(j), src, np.int64)), pa.array(turn.astype(np.int32)), pa.array(place), pa.array(most)], names=["shard", "src", "pass", "block", "most"])

        return step

    return ranges.repartition(parts, "src", "first").mapInArrow(common.batches(start), "shard long, src long, pass int, block long, most long")


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, h, k): (h, k) tells rows apart, also repeated ones."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return numbered(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("h")))


def numbered(df: DataFrame) -> DataFrame:
    """Number the rows of each h, which are repeated rows, so that equal rows get the same numbers anywhere."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("doc_id", "source")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Mix documents: (rows, parts).

    rows: doc_id, source, size, h, k, src, source_size, target, one per document. parts: the mix itself, shard,
    src, pass, block and the words that each document gives to the slot: h, k, start (word number), length.
    A source takes its target to within one block; with most a whole number, no block is taken more than ``most``
    times. Null texts have size 0; null is a source of its own. Of repeated rows each is taken on its own. Sources of
    equal ratio are capped in their order. Equal inputs mix equally, and an empty table gives an empty mix.
    """
    base = common.stored(sized(docs), "sizes")
    plan = common.stored(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rows = base.join(plan, base["source"].eqNullSafe(plan["source"])).select(base["*"], "src", "source_size", "target")
    words = F.least(F.round("target"), F.lit(most) * F.col("source_size")).cast("long")
    recipe = plan.where("source_size > 0").select(F.col("src").cast("long").alias("src"), F.col("source_size"), F.ceil(F.col("source_size") / block).alias("blocks"), words.alias("words"))
    recipe = recipe.select("src", "blocks", F.floor(F.col("words") / F.col("source_size")).alias("turns"), (F.col("words") % F.col("source_size")).alias("rest"))
    total = plan.agg(F.sum("target")).first()[0] or 0
    cells = max(1, -(-base.count() // CELL_DOCS))
    rows = rows.withColumn("cell", F.pmod(F.col("h"), F.lit(cells)))
    known = rows.groupBy("src", "cell").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("src").orderBy("cell")) - F.col("n")
    known = known.select("src", "cell", ahead.alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("src", "cell").orderBy("h", "k")) - F.col("size")
    placed = rows.where("size > 0").withColumn("inside", inside).join(known, ["src", "cell"])
    placed = placed.select("src", "h", "k", "size", (F.col("ahead") + F.col("inside")).alias("at"))
    n = F.lit(block)
    pieces = placed.select("*", F.explode(F.sequence(F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("size") - 1) / n))).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * n)
    pieces = pieces.select("src", "block", "h", "k", (begin - F.col("at")).alias("start"), (begin - F.col("block") * n).alias("ahead"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * n) - begin).alias("length"))
    # both sides grow with the documents; Spark cannot size the slots, so the join is named
    shards = max(1, -(-int(total) // (block * SHARD_SLOTS)))
    parts = slots(recipe, shards, block, seed).hint("merge").join(pieces, ["src", "block"])
    length = F.least("length", F.col("most") - F.col("ahead"))
    parts = parts.withColumn("length", length).where("length > 0").drop("most", "ahead")
    return rows.drop("cell"), parts


def op3_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, and the words that the mix takes of each."""
    rows, parts = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = parts.groupBy("h", "k").agg(F.sum("length").alias("taken"))
    return rows.join(taken, ["h", "k"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and pass with the words taken, joined by blanks, in their order.

    Other columns stay as they were. A document from which nothing is taken goes, and so do null and empty texts. Of rows
    that repeat doc_id and text each is mixed on its own. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    _, parts = mix(docs)
    taken = parts.groupBy("h", "k").agg(F.collect_list(F.struct("pass", "start", "length")).alias("cuts"))
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.xxhash64("doc_id", "text").alias("h"), "doc_id", "source")
    joined = numbered(own).join(taken, ["h", "k"])
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            of, texts = [], []
            for i, (text, cuts) in enumerate(zip(common.texts(batch.column(at)), batch.column(len(names)), strict=True)):
                words, mixed = text.split(), {}
                for turn, first, length in sorted(zip(*(cuts.values.field(k).to_pylist() for k in ("pass", "start", "length")), strict=True)):
                    mixed.setdefault(turn, []).extend(words[first : first + length])
                of += [i] * len(mixed)
                texts += [b" ".join(own) for own in mixed.values()]
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i).take(pa.array(of, pa.int32())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        return step

    out = joined.select(*names, "cuts").mapInArrow(common.batches(start), joined.select(*names).schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
