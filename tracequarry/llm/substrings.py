"""Substring dedup by difference-cover anchors.

A cover of residues modulo PERIOD such that any two positions, shifted together by less than PERIOD, both fall
on it: two equal windows of ``window`` words anywhere in two documents contain equal shorter windows (anchors)
of window - PERIOD + 1 words that both start on the cover. Only anchors are compared across the corpus. Around
anchors that more than one document has, whole windows are hashed and compared: the exact extension.

Occurrences of a hash within one task are settled there, so a passage that very many documents share
sends one row per task, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 50
#: A perfect difference set: each difference modulo 31 arises once, so each shift below 31 is covered.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Anchors or windows that a task settles at once.
LOCAL_ROWS = 400_000
#: Stands for a null doc_id, which is larger than all others.
LAST = 2**63 - 1


def cover_positions(n: int, length: int) -> np.ndarray:
    """Starts of anchors of so many words in n words."""
    at = np.arange(max(0, n - length + 1))
    return at[np.isin(at % PERIOD, COVER)]


def sequence_key(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


class _Settled:
    """Hash occurrences of a task: rows (key, doc, row, places, known), row telling rows of documents apart.

    Of each hash the smallest document's places stay to be compared (known false). Places of other documents
    are known to repeat; they go as one line per row under a key of the row.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes, self.docs, self.of, self.places, self.rows = [], [], [], [], 0

    def add(self, doc: int, row: int, hashes: np.ndarray, places: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.docs.append(np.full(len(hashes), doc, np.int64))
        self.of.append(np.full(len(hashes), row, np.int64))
        self.places.append(places.astype(np.int32))
        self.rows += len(hashes)

    def flush(self, smallest_repeats: bool) -> Iterator[pa.RecordBatch]:
        """smallest_repeats: a hash that two documents of the task have repeats in the smallest one as well."""
        if not self.rows:
            return
        h, d, r, p = (np.concatenate(x) for x in (self.hashes, self.docs, self.of, self.places))
        self.clear()
        order = np.lexsort((p, d, h))
        h, d, r, p = h[order], d[order], r[order], p[order]
        first = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(first) - 1
        known = d > d[first][group]
        if smallest_repeats:
            known = (np.bincount(group, known) > 0)[group]
            send = first | ~known
        else:
            send = ~known  # each place in the smallest document needs its own answer
        for lo in range(0, int(send.sum()), 50_000):
            at = np.flatnonzero(send)[lo : lo + 50_000]
            yield self._rows(common.signed(h[at]), d[at], r[at], np.split(p[at], np.arange(1, len(at))), np.zeros(len(at), bool))
        if known.any():
            d, r, p = d[known], r[known], p[known]
            order = np.lexsort((p, r))
            d, r, p = d[order], r[order], p[order]
            cut = np.flatnonzero(np.r_[False, r[1:] != r[:-1]])
            at = np.r_[0, cut]
            yield self._rows(common.signed(common.mixed(r[at].view(np.uint64))), d[at], r[at], np.split(p, cut), np.ones(len(at), bool))

    def _rows(self, keys: np.ndarray, docs: np.ndarray, rows: np.ndarray, places: list[np.ndarray], known: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs), pa.array(rows), common.list_of(places, pa.int32()), pa.array(known)], names=["key", "doc", "row", "places", "known"])


SETTLED = "key long, doc long, row long, places array<int>, known boolean"


def _repeated(rows: DataFrame, test: str) -> DataFrame:
    """(row, places) of what repeats: known places, and those whose key's documents pass the test."""
    own = Window.partitionBy("key", "known")
    marked = rows.withColumns({"low": F.min("doc").over(own), "high": F.max("doc").over(own)})
    return marked.where(F.col("known") | F.expr(test)).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc, text): hash of doc_id and text, doc_id with null last, text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")


def sequences(docs: DataFrame) -> DataFrame:
    """(row, doc, seq, n): seq is a hash of the word sequence of n words."""

    def start():
        hashes = common.WordHashes()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own = [hashes.of(t.split()) for t in common.texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sequence_key(h) for h in own], pa.int64()), pa.array(map(len, own), pa.int64())], names=["row", "doc", "seq", "n"])

        return step

    return _keyed(docs).mapInArrow(common.batches(start), "row long, doc long, seq long, n long")


def _anchors(window: int):
    length = window - PERIOD + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, settled = common.WordHashes(), common.odd_weights(length), _Settled()
        for batch in it:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2)), strict=True):
                h = hashes.of(text.split())
                at = cover_positions(len(h), length)
                settled.add(doc, row, common.rolling(h, length, weights)[at], at)
            if settled.rows > LOCAL_ROWS:
                yield from settled.flush(True)
        yield from settled.flush(True)

    return run


def _windows(window: int):
    length = window - PERIOD + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, settled = common.WordHashes(), common.odd_weights(window), _Settled()
        for batch in it:
            for row, doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                h = hashes.of(text.split())
                m = len(h) - window + 1
                if m <= 0:
                    continue
                # a window that holds the anchor at a starts from a - (window - length) to a
                near, at = np.zeros(m + window + 1, np.int32), np.array(places, np.int64)
                np.add.at(near, np.clip(at - (window - length), 0, m), 1)
                np.add.at(near, np.clip(at + 1, 0, m), -1)
                starts = np.flatnonzero(np.cumsum(near[:m]) > 0)
                settled.add(doc, row, common.rolling(h, window, weights)[starts], starts)
            if settled.rows > LOCAL_ROWS:
                yield from settled.flush(False)
        yield from settled.flush(False)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word in a window of ``window`` words whose sequence also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one blank) per row. Words are runs without
    ASCII white space, unchanged. Windows are judged on the input. A null or empty text has no words. A null
    doc_id counts as larger than any other. Repeated rows give repeated results; rows of one doc_id do not remove
    each other's words. An empty table gives an empty result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = common.stored(sequences(docs), "sequences").where(f"n >= {window}")
    first = seqs.groupBy("seq").agg(F.min("doc").alias("low"))
    marked = seqs.join(first, "seq").select("row", (F.col("doc") == F.col("low")).alias("leads")).distinct()
    # texts are dealt by row once; the three readers below share that exchange
    texts = _keyed(docs).repartition(parts, "row")
    own = texts.join(marked.where("leads").select("row").hint("merge"), "row").select("row", "doc", "text")
    anchors = _repeated(own.mapInArrow(_anchors(window), SETTLED), "high > low")
    near = texts.join(anchors.hint("merge"), "row").select("row", "doc", "text", "places")
    removed = _repeated(near.mapInArrow(_windows(window), SETTLED), "doc > low")
    copies = marked.where("not leads").select("row", F.lit(True).alias("copy"))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts, gone, kept = [], [], []
            for text, starts, whole in zip(common.texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                if whole:
                    keep = np.zeros(len(words), bool)
                else:
                    hit, at = np.zeros(len(words) + 1, np.int32), np.array(starts or (), np.int64)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + window, -1)
                    keep = np.cumsum(hit[:-1]) == 0
                counts.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])

        return step

    full = texts.join(removed.hint("merge"), "row", "left").join(copies.hint("merge"), "row", "left").select("doc", "text", "places", "copy")
    out = full.mapInArrow(common.batches(start), "doc long, n_words long, n_removed long, kept_text string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def op6_difference_cover(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat 50-word passages of earlier documents, and a digest of what is kept."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


