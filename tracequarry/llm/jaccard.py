"""N-gram Jaccard join by multiple global orders.

Every order of all shingles, applied to each set, has the prefix property: two sets similar enough share a
shingle among the first n - ceil(t n) + 1 of each. Three orders are used, all from rare to frequent by a fixed-size
count of all shingles, each with its own order within a frequency. The first generates candidates, which must keep
bounds of length, position and bitmap and then share prefix shingles under the second and the third order as well;
what is left is verified on the whole sets. Equal sets are one class throughout, so copies never meet pairwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Slots of the frequency count: about SLOTS per document, as a power of two within these bounds (at most 16 MB).
SLOTS, LEAST_BITS, MOST_BITS = 16, 12, 24
CHUNKS = 64
#: Documents whose ids may be broadcast to fetch their texts; beyond it the fetch is a shuffled join.
BROADCAST_ROWS = 500_000
ORDERS = 3
#: Parity bits of a set: two sets differ in at least as many shingles as their bitmaps do in bits.
BITMAP_BITS = 11
BITMAP = 1 << BITMAP_BITS
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Shingler:
    """Distinct shingle hashes of a text: A-Z lower-cased, words at ASCII white space, n words each."""

    def __init__(self, n: int) -> None:
        self.n, self.hashes, self.weights = n, common.WordHashes(), common.odd_weights(2 * n)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        h = self.hashes.of(words)
        if len(h) >= self.n:
            return np.unique(common.rolling(h, self.n, self.weights))
        return common.rolling(h, len(h), self.weights[self.n :]) if len(h) else h


def frequency_classes(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Size class (log2 of a count) of each of 2**bits slots that all documents' shingles hash to.

    Each task counts into one array of fixed size; the arrays are added slice by slice on the executors.
    """
    width = (1 << bits) // CHUNKS

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(n), np.zeros(1 << bits, np.uint32)
        for batch in it:
            slots = [shingles(t) & np.uint64((1 << bits) - 1) for t in common.texts(batch.column(0))]
            flat = np.concatenate(slots) if slots else np.empty(0, np.uint64)
            if len(flat):
                at, many = np.unique(flat, return_counts=True)
                counts[at] += many.astype(np.uint32)
        for k in range(CHUNKS):
            part = counts[k * width : (k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros(width, np.int64))
                total[k] += np.frombuffer(zlib.decompress(data), np.uint32)
        for k, counts in total.items():
            size = np.log2(np.maximum(counts, 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size.tobytes()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << bits, np.uint8)
    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(8, "chunk").mapInArrow(add, "chunk int, counts binary")
    for row in parts.collect():  # 2**bits bytes in all
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(bytes(row["counts"]), np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(shingles: np.ndarray, classes: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first shingles in a global order, in that order."""
    size = classes[shingles & np.uint64(len(classes) - 1)].astype(np.uint64)
    own = common.mixed(shingles ^ _SALTS[order])
    key = size << np.uint64(58) | own >> np.uint64(6)
    near = np.argpartition(key, length - 1)[:length] if length < len(key) else np.arange(len(key))
    return shingles[near[np.argsort(key[near])]]


def fingerprints(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document: doc_id, h (hash of doc_id and text), n, cls (hash of the set, null if empty), bits (parity bitmap), p1, p2, p3."""
    spark = docs.sparkSession
    bits = min(max(int(SLOTS * max(docs.count(), 1)).bit_length(), LEAST_BITS), MOST_BITS)
    classes = spark.sparkContext.broadcast(frequency_classes(docs, n, bits))

    def start():
        shingles, size = Shingler(n), classes.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts, keys, bitmaps, prefixes = [], [], [], ([], [], [])
            for text in common.texts(batch.column(2)):
                own = shingles(text)
                counts.append(len(own))
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 if len(own) else None)
                parity = np.bincount((own >> np.uint64(64 - BITMAP_BITS)).astype(np.int64), minlength=BITMAP) & 1
                bitmaps.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                for k in range(ORDERS):
                    first = ordered_prefix(own, size, k, prefix_length(len(own), percent)) if len(own) else own
                    prefixes[k].append(common.signed(first) if k == 0 else (first >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(keys, pa.int64()), common.list_of(bitmaps, pa.int64()), common.list_of(prefixes[0], pa.int64()), common.list_of(prefixes[1], pa.int32()), common.list_of(prefixes[2], pa.int32())],
                names=["doc_id", "h", "n", "cls", "bits", "p1", "p2", "p3"],
            )

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(common.batches(start), f"doc_id {kind}, h long, n int, cls long, bits array<long>, p1 array<long>, p2 array<int>, p3 array<int>")


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil(percent * (na + nb) / (100.0 + percent) - 1e-9)


def _close(percent: int) -> Column:
    """Bounds that every linked pair meets, for columns n, bits of sides a and b: length, and symmetric difference by parity bitmaps."""
    na, nb = F.col("n_a"), F.col("n_b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart <= na + nb - 2 * _least_overlap(na, nb, percent))


def shared_prefixes(classes: DataFrame) -> DataFrame:
    """(token, cls, pos, low): prefix shingles of the first order that several classes have, and the smallest of those classes."""
    own = Window.partitionBy("token")
    spots = classes.select("cls", F.posexplode("p1").alias("pos", "token"))
    return spots.withColumns({"low": F.min("cls").over(own), "high": F.max("cls").over(own)}).where("low < high").select("token", "cls", "pos", "low")


def under_all_orders(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within the bounds that share prefix shingles under the second and the third order as well."""
    for s in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "bits", "p2", "p3")]), s)
    return pairs.where(_close(percent) & F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b")


def star_candidates(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each class with the smallest one of each of its shingles: no more pairs than rows."""
    return under_all_orders(shared.where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct(), classes, percent)


def cross_candidates(shared: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a shingle but no component yet. Bounds of length, position and bitmap hold inside the join."""
    rows = shared.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = Window.partitionBy("token")
    rows = rows.withColumns({"r0": F.min("root").over(own), "r1": F.max("root").over(own)}).where("r0 < r1")
    words = range(BITMAP // 64)
    info = classes.select("cls", "n", *[F.get("bits", F.lit(k)).alias(f"w{k}") for k in words])
    rows = rows.select("token", "cls", "pos", "root").join(info, "cls")
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "pos", "root", "n", *[f"w{k}" for k in words])]) for s in ("a", "b"))
    na, nb = F.col("n_a"), F.col("n_b")
    overlap = _least_overlap(na, nb, percent)
    near = (F.col("cls_a") < F.col("cls_b")) & (F.col("root_a") != F.col("root_b")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    near &= F.least(na - F.col("pos_a"), nb - F.col("pos_b")) >= overlap
    near &= sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in words), F.lit(0)) <= na + nb - 2 * overlap
    pairs = a.hint("merge").join(b, (a["token"] == b["token"]) & near).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    return under_all_orders(pairs, classes, percent)


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows (cls, shingles) for rows (cls, h) of wanted classes and one of their documents."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def start():
        shingles = Shingler(n)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [common.signed(shingles(t)) for t in common.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), common.list_of(sets, pa.int64())], names=["cls", "shingles"])

        return step

    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).join(wanted, "h").select("cls", "text")
    return rows.mapInArrow(common.batches(start), "cls long, shingles array<long>").groupBy("cls").agg(F.any_value("shingles").alias("shingles"))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are at least percent similar."""
    pairs = common.stored(pairs, "pairs")
    active = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = common.stored(class_sets(docs, classes.select("cls", "h").join(active, "cls", "left_semi"), n), "sets")
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"s{side}")).hint("merge"), side)
    inter = F.size(F.array_intersect("sa", "sb"))
    measured = both.select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb") - inter).alias("either"))
    links = common.stored(measured.where(100 * F.col("inter") >= percent * F.col("either")).select("a", "b"), "links")
    common.dropped(pairs, sets)
    return links


def linked_components(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) of the classes that link with any other.

    First each class is tried with the smallest class of each prefix shingle, which joins most of a large family of
    near copies by as many pairs as it has rows. Then only pairs between different components are tried, so no
    family is taken apart pair by pair, and no link between components is lost.
    """
    shared = common.stored(shared_prefixes(classes), "shared")
    first = verified(docs, classes, star_candidates(shared, classes, percent), n, percent)
    roots = common.components(first)
    second = verified(docs, classes, cross_candidates(shared, classes, roots, percent), n, percent)
    common.dropped(shared)
    return common.components(first.union(second))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, h, n_shingles, cls, root (of its component), component_id (smallest doc_id of its component).

    Documents link when 100 * intersection >= percent * union of their sets of n-word shingles; with fewer
    words the whole sequence is the one shingle. A null or empty text has no shingle and links with nothing, so
    component_id is its own doc_id. A null doc_id is never the smallest; a component of null ids has null.
    Repeated rows are members of one class. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    prints = common.stored(fingerprints(docs, n, percent), "fingerprints")
    classes = prints.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("h").alias("h"), F.any_value(F.struct("n", "bits", "p1", "p2", "p3")).alias("x")).select("cls", "low", "h", "x.*")
    classes = common.stored(classes, "classes")
    roots = linked_components(docs, classes, n, percent)
    lows = roots.join(classes.select(F.col("cls").alias("node"), "low"), "node")
    lows = lows.join(lows.groupBy("root").agg(F.min("low").alias("lowest")), "root").select(F.col("node").alias("cls"), "root", "lowest")
    own = classes.select("cls", "low").join(lows, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("lowest", "low").alias("group_low"))
    out = prints.select("doc_id", "h", "n", "cls").join(own, "cls", "left")
    out = out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "cls", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("group_low")).alias("component_id"))
    out = common.stored(out, "groups")
    common.dropped(prints, classes)
    return out


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents without their near-duplicates: each component keeps the row with its smallest doc_id.

    Rows that repeat that doc_id and text are one document, and of different texts with one doc_id in one component
    the one with the smallest hash stays. Documents without words all stay, null texts too. Texts are read whole, however long.
    Columns stay as they are. An empty table gives an empty one.
    """
    groups = similar_groups(docs, n, percent).select("h", "root", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"))
    linked = groups.where("root is not null").groupBy("root").agg(F.min(F.struct("doc", "h")).alias("x")).select("x.h")
    kept = linked.union(groups.where("root is null").select("h")).distinct().withColumnRenamed("h", "kept_h")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("kept_h"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    texts = keyed.join(kept.hint("merge"), "kept_h")
    bare = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    again = F.row_number().over(Window.partitionBy("kept_h").orderBy("kept_h"))
    return texts.withColumn("again", again).where((F.col("again") == 1) | ~bare).select("row.*")


def op4_global_orders(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at 85 percent."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85).select("doc_id", "n_shingles", "component_id")
