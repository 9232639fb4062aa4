"""Vector code compression: product codes from weighted Lloyd rounds over distinct parts.

Components become integers and vectors are cut into parts. Equal parts of a position are one row with a weight, so a round
reads each distinct part once; a round's sums are one small row for each entry and task. Codes and errors of the distinct
parts are joined back to the vectors: parts that bear more than a thousandth of a position's rows (fewer than a thousand
for each position, by count) by broadcast, all others by a shuffled join, where no key is hot any more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Parts with more than the HEAVY-th share of a position's rows are joined by broadcast.
HEAVY = 1000
#: Numbers that a task compares with an entry at once.
BLOCK = 1 << 20
MOST = 2**63 - 1
_CUT = np.int64(31)

Books = list[np.ndarray]


def vector_parts(vectors: DataFrame, vec: str = "embedding", parts: int = PARTS) -> DataFrame:
    """(row, vec_id, label, parts) of the vectors without a null or non-finite component, written once.

    Vectors shorter than the longest are filled with zeros, and all to a multiple of the parts.
    """
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(x.isNotNull() & ~bad).select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("ints"))
    rows = common.stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    wide = -(-max(rows.agg(F.max(F.size("ints"))).first()[0] or 0, 1) // parts)
    filled = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(wide * parts) - F.size("ints")))
    return rows.select("row", "vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(filled, i * wide + 1, F.lit(wide))).alias("parts"))


def _safe(*tables: np.ndarray, times: int = 1) -> bool:
    """Whether sums of so many squared differences fit 64 bits."""
    most = max((max(int(t.max(initial=0)), -int(t.min(initial=0))) for t in tables), default=0)
    return (2 * most) ** 2 * max(times, 1) < MOST


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower of two, and the squared distance; Python's integers where 64 bits don't do."""
    if not _safe(rows, book, times=rows.shape[1]):
        rows, book = rows.astype(object), book.astype(object)
    best, at = None, np.zeros(len(rows), np.int64)
    for k, entry in enumerate(book):
        d = ((rows - entry) ** 2).sum(axis=1)
        if best is None:
            best = d
            continue
        closer = (d < best).astype(bool)
        at[closer], best[closer] = k, d[closer]
    return at, best


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, row numbers in the batch, parts) of a batch, in blocks."""
    pos = batch["pos"].to_numpy(zero_copy_only=False)
    column = batch["part"]
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    step = max(1, BLOCK // max(flat.shape[1], 1))
    for p in np.unique(pos):
        own = np.flatnonzero(pos == p)
        for lo in range(0, len(own), step):
            at = own[lo : lo + step]
            yield int(p), at, flat[at]


def _assign(books: Books):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            code, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, rows in _blocks(batch):
                code[at], d = nearest(rows, books[p])
                dist[at] = np.minimum(d, MOST).astype(np.int64)
            yield pa.record_batch([batch["pos"], batch["part"], batch["weight"], pa.array(code), pa.array(dist)], names=["pos", "part", "weight", "code", "dist"])

    return run


def _sums(books: Books):
    """Sums and weights for each (pos, code) of a task. A sum is in two halves, high * 2^31 + low, so that none overflows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in it:
            weights = batch["weight"].to_numpy(zero_copy_only=False)
            for p, at, rows in _blocks(batch):
                code, _ = nearest(rows, books[p])
                w = weights[at]
                for k in np.unique(code):
                    own = code == k
                    x, m = rows[own], w[own]
                    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
                    if most * int(m.sum()) >= MOST:
                        x, m = x.astype(object), m.astype(object)
                    total = (x * m[:, None]).sum(axis=0).astype(object)
                    sums = held.setdefault((p, int(k)), [total * 0, 0])
                    sums[0], sums[1] = sums[0] + total, sums[1] + int(m.sum())
        if held:
            cells = [(p, k, j, int(v) >> 31, int(v) & (1 << 31) - 1, n) for (p, k), (total, n) in held.items() for j, v in enumerate(total)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)], names=["pos", "code", "at", "high", "low", "n"])

    return run


def lloyd(distinct: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    """The codebooks after the rounds; distinct has (pos, part, weight). Entries without parts stay.

    What comes to the driver is a number for each component of each entry, whatever the input's size.
    """
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "pos int, code int, at int, high long, low long, n long")
        sums = sums.groupBy("pos", "code", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():
            books[r["pos"]][r["code"], r["at"]] = ((r["high"] << 31) + r["low"]) // r["n"]
    return books


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> Books:
    """For each position, the parts of the vectors of smallest vec_id; fewer vectors give fewer entries."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    return [np.array([r["parts"][p] for r in rows], np.int64) for p in range(len(rows[0]["parts"]))] if rows else []


def joined_back(vectors: DataFrame, coded: DataFrame) -> DataFrame:
    """(vec_id, label, code, error) of each vector from the codes and errors of its distinct parts."""
    n = coded.where("pos = 0").agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") * HEAVY > n
    each = vectors.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    tried = each.join(F.broadcast(coded.where(heavy).drop("weight")), ["pos", "part"], "left")
    rare = tried.where("code is null").drop("code", "dist").join(coded.where(~heavy).drop("weight").hint("shuffle_hash"), ["pos", "part"])
    found = tried.where("code is not null").unionByName(rare)
    byte = F.call_function("shiftleft", F.col("code").cast("long"), (F.lit(PARTS - 1) - F.col("pos")) * 8)
    out = found.groupBy("row", "vec_id", "label").agg(F.sum(byte).alias("code"), F.sum(F.col("dist").cast("decimal(38,0)")).alias("error"))
    return out.select("vec_id", "label", F.lpad(F.lower(F.hex("code")), 2 * PARTS, "0").alias("code"), F.least("error", F.lit(MOST)).cast("long").alias("error"))


def compressed(vectors: DataFrame) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of the vectors, and the codebooks.

    Vectors that are null or hold a null or non-finite component are dropped. Repeated rows and ids stay rows of their own; ids
    tie by their parts, null is the last id. An empty vector is all zeros. Fewer vectors than entries give fewer entries.
    Arithmetic is exact for components below 2^51; a distance beyond 64 bits is reported as the largest 64-bit number. Other
    columns are not read. An empty table gives no rows and no books.
    """
    cut = vector_parts(vectors)
    distinct = cut.select(F.posexplode("parts").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    distinct = common.stored(distinct, "parts")
    books = first_books(cut)
    books = lloyd(distinct, books) if books else books
    coded = common.stored(distinct.mapInArrow(_assign(books), "pos int, part array<long>, weight long, code int, dist long"), "coded")
    return joined_back(cut, coded), books


def books_digest(books: Books) -> str:
    """SHA-256 of all entries' components as decimal numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, with their label's total error."""
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = common.stored(rows, "codes")
    sums = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    sums = common.stored(sums.withColumnRenamed("label", "of"), "labels")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
