"""Token counts of documents of any length: overlapping chunks, spliced where both are proven to agree.

A byte-level BPE first cuts text into words by a pattern that scans from left to right, then merges within words. The scan
has no memory but its place, so once two scans of one text both have a word begin at a place, they go on alike: a common
word begin in an overlap is a proven splice, and the tokens of a document are the tokens of the first chunk before it plus
those of the second from it on. Word begins close to a chunk's end are left out, as text beyond the end can change them. An
overlap without a common word begin (a word longer than the overlap) is widened over the whole of the chunks that follow:
one, then two, then four.

Within a chunk, too, pieces are counted by themselves where a single blank or line end proves a word begin, so that a worker
encodes a piece once; only pieces in an overlap are encoded with offsets.

Texts of one chunk are counted where they are read. Chunks of longer ones are dealt out, so that tasks share a huge text, and
a worker encodes no more than a chunk at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk, and on each side of a cut that its neighbours share.
CHUNK, OVERLAP = 16_384, 256
#: Characters after a word's end that the pattern may look at.
LOOK_AHEAD = 4
#: Pieces, and their characters, from which a worker's memory starts anew; it saves time only. Pieces of one call.
MEMO_PIECES, MEMO_BYTES, CALL_PIECES = 600_000, 16 << 20, 500

#: A blank or line end alone between other characters, and what pieces begin with, in texts and in byte-level tokens.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_FIRST, _BEGINS = " \n", "ĠĊ"
_INSIDE = re.compile(r"[ \n]")
_MARKS, _LETTERS = frozenset(".,;:!?"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

_PIECES = "digest binary, cut int, next int, start long, piece string, spread long"
_FACTS = "digest binary, cut int, side string, at array<long>, before array<long>, total long"


class Counter:
    """Tokens of pieces of texts by a tokenizer file, kept while the worker sees them again.

    Pieces are cut before a single blank or line end that stands between other characters: there the pattern has a word begin,
    whatever else is in the text. ``margin`` is None where nothing proves a splice; then texts are encoded whole.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.margin = margin(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in _BEGINS]] = True
        self.memo: dict[str, int] = {}
        self.begun: dict[str, list[tuple[int, int]]] = {}  # of pieces in overlaps: where words begin, and the tokens before
        self.bytes = 0

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        """Find the tokens of new pieces: many to a call, as their first characters tell them apart in the tokens."""
        bare = {p: p[:-1] if len(p) > 2 and p[-1] in _MARKS and p[-2] in _LETTERS else p for p in pieces}
        new = [p for p in {*bare.values(), *_MARKS} if p not in self.memo]
        plain = [p for p in new if p and p[0] in _FIRST and not _INSIDE.search(p, 1)]
        for lo in range(0, len(plain), CALL_PIECES):
            part = plain[lo : lo + CALL_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.begins[ids])
            counts = np.diff(np.r_[starts, len(ids)]).tolist() if len(starts) == len(part) else self.encoded(part)
            self.memo.update(zip(part, counts, strict=True))
        rest = [p for p in new if p not in self.memo]
        self.memo.update(zip(rest, self.encoded(rest), strict=True))
        # a mark that ends a piece after a letter is a word of its own
        self.memo.update({p: self.memo[b] + self.memo[p[-1]] for p, b in bare.items() if p is not b})
        self.bytes += sum(map(len, pieces))

    def cut(self, text: str) -> list[str]:
        return _CUT.split(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.margin is None:
            return self.encoded(texts)
        parts = [self.cut(t) for t in texts]
        self.know(parts)
        return [sum(map(self.memo.__getitem__, p)) for p in parts]

    def know(self, parts: list[list[str]]) -> None:
        if len(self.memo) > MEMO_PIECES or self.bytes > MEMO_BYTES:
            self.memo.clear()
            self.begun.clear()
            self.bytes = 0
        new: set[str] = set()
        for p in parts:
            new.update(set(p).difference(self.memo))
        self.learn(new)

    def words(self, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
        """Where words begin within spans of a text, the tokens before each, and the tokens of all. Only pieces in a span are encoded with offsets."""
        parts = self.cut(text)
        self.know([parts])
        ends = np.cumsum([len(p) for p in parts])
        tokens = np.cumsum([self.memo[p] for p in parts])
        near = sorted({i for lo, hi in spans for i in range(np.searchsorted(ends, lo), min(len(parts), np.searchsorted(ends, hi) + 1))})
        new = list({parts[i] for i in near} - self.begun.keys())
        for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            first, offsets, last = [], e.offsets, -1
            for k, word in enumerate(e.word_ids):
                if word != last:
                    first.append((offsets[k][0], k))
                last = word
            self.begun[p] = first
        at, before = [], []
        for i in near:
            start, ahead = int(ends[i]) - len(parts[i]), int(tokens[i]) - self.memo[parts[i]]
            at += [start + x for x, _ in self.begun[parts[i]]]
            before += [ahead + k for _, k in self.begun[parts[i]]]
        return np.array(at, np.int64), np.array(before, np.int64), int(tokens[-1])


def margin(file: str) -> int | None:
    """Characters before a chunk's end in which word begins are not proven; None if the file's tokenizer is of another kind."""
    with open(file, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    added = made.get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(c.isspace() for t in added for c in t["content"])
    scans = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not scans or not plain or made.get("normalizer") or made.get("post_processor") or made.get("truncation") or made.get("padding"):
        return None
    # an added token that begins within the look-ahead must be in sight as a whole
    return LOOK_AHEAD + max((len(t["content"]) for t in added), default=0)


def whole_counts(docs: DataFrame, file: str, chunk: int, keep: tuple[str, ...], text: str) -> DataFrame:
    """(keep, n_bytes, n_tokens, digest): the count of each text of at most a chunk, the digest of each longer one."""
    names, kept = common.kept_names(docs, keep, ["n_bytes", "n_tokens", "digest", "text"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in it:
            held = batch["text"].to_pylist()
            short = [i for i, t in enumerate(held) if t is not None]
            n: list[int | None] = [None] * len(held)
            for i, k in zip(short, counter.counts([held[i] for i in short]), strict=True):
                n[i] = k
            yield pa.record_batch([*(batch[c] for c in names), batch["n_bytes"], pa.array(n, pa.int64()), batch["digest"]], names=[*names, "n_bytes", "n_tokens", "digest"])

    whole = F.coalesce(F.col(text), F.lit(""))
    long = F.char_length(whole) > chunk
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)]
    rows = docs.select(*columns, F.octet_length(whole).cast("long").alias("n_bytes"), F.when(long, F.unhex(F.sha2(whole, 256))).alias("digest"), F.when(~long, whole).alias("text"))
    return common.stored(rows.mapInArrow(run, kept + "n_bytes long, n_tokens long, digest binary"), "counts")


def chunk_rows(longs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of (digest, text, gone, fresh) between the cuts that are not gone; all of them, or those at cuts newly gone where fresh is set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in it:
            for digest, text, gone, fresh in zip(*(batch[c].to_pylist() for c in ("digest", "text", "gone", "fresh")), strict=True):
                off = set(gone or ())
                cuts = [0, *(k for k in range(1, -(-len(text) // chunk)) if k not in off)]
                for a, b in zip(cuts, [*cuts[1:], -1], strict=True):
                    if fresh is None or any(a < k and (k < b or b < 0) for k in fresh):
                        lo, hi = max(0, a * chunk - overlap), len(text) if b < 0 else min(len(text), b * chunk + overlap)
                        spread = xxhash.xxh3_64_intdigest(f"{part} {seen}".encode()) >> 1
                        seen += 1
                        yield pa.record_batch([pa.array([x], t) for x, t in ((digest, pa.binary()), (a, pa.int32()), (b, pa.int32()), (lo, pa.int64()), (text[lo:hi], pa.string()), (spread, pa.int64()))], names=common.fields(_PIECES))

    return longs.select("digest", "text", "gone", "fresh").mapInArrow(run, _PIECES).repartition("spread")


def facts_of(pieces: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """What a chunk says of each of its cuts: word begins in the overlap and the tokens before them; the last chunk says its total."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in it:
            rows = []
            for digest, a, b, start, piece in zip(*(batch[c].to_pylist() for c in ("digest", "cut", "next", "start", "piece")), strict=True):
                sides = [(k, side, k * chunk - overlap, k * chunk + overlap - less) for k, side, less in ((a, "right", 0), (b, "left", counter.margin)) if k > 0]
                at, before, total = counter.words(piece, [(low - start, high - start) for _, _, low, high in sides])
                at = at + start
                for k, side, low, high in sides:
                    own = (at >= low) & (at <= high)
                    rows.append((digest, k, side, at[own].tolist(), before[own].tolist(), None))
                if b < 0:
                    rows.append((digest, 0, "total", None, None, total))
            kinds = (pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=common.fields(_FACTS))

    return pieces.mapInArrow(run, _FACTS)


def seams(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """(digest, cut, more): for each cut that stands, the tokens before the splice in the left chunk less those in the right one, null without one; for cut 0 the total."""
    side = lambda name: F.max_by(F.struct("at", "before"), F.when(F.col("side") == name, F.col("round")))
    rows = facts.join(gone, ["digest", "cut"], "left_anti").groupBy("digest", "cut")
    rows = rows.agg(side("left").alias("l"), side("right").alias("r"), F.max_by("total", F.when(F.col("side") == "total", F.col("round"))).alias("total"))
    place = F.array_min(F.array_intersect("l.at", "r.at"))
    tokens = lambda s: F.get(f"{s}.before", F.array_position(f"{s}.at", place).cast("int") - 1)
    return rows.select("digest", "cut", F.when(F.col("cut") == 0, F.col("total")).otherwise(tokens("l") - tokens("r")).alias("more"))


def spliced_counts(longs: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of distinct texts longer than a chunk; longs has (digest, text), copies included.

    A round drops the cuts at which no splice was found, and 1, 3, 7, .. cuts after each, and encodes the chunks that this
    joins; a text that has no cut left is one chunk. Rounds are at most the logarithm of the cuts.
    """
    none = F.lit(None).cast("array<int>")
    facts = facts_of(chunk_rows(longs.select("digest", "text", none.alias("gone"), none.alias("fresh")), chunk, overlap), file, chunk, overlap)
    facts = common.stored(facts.dropDuplicates(["digest", "cut", "side"]).withColumn("round", F.lit(0)), "facts")
    gone = facts.select("digest", "cut").limit(0)
    for turn in range(1, 64):
        found = common.stored(seams(facts, gone), "seams")
        torn = found.where("more is null").select("digest", "cut")
        if torn.isEmpty():
            break
        fresh = torn.select("digest", F.explode(F.sequence("cut", F.col("cut") + F.lit((1 << turn - 1) - 1).cast("int"))).alias("cut")).distinct()
        gone = common.stored(gone.union(fresh).distinct(), "gone")
        lists = gone.groupBy("digest").agg(F.collect_list("cut").alias("gone")).join(fresh.groupBy("digest").agg(F.collect_list("cut").alias("fresh")), "digest")
        again = longs.join(lists.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text")).join(lists, "digest")
        more = facts_of(chunk_rows(again, chunk, overlap), file, chunk, overlap).withColumn("round", F.lit(turn))
        facts = facts.unionByName(common.stored(more, "facts"))
    return found.groupBy("digest").agg(F.sum("more").alias("n_tokens"))


def token_counts(docs: DataFrame, file: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit of each whole text; added tokens in texts count as the library has it.

    A null text is empty and has no tokens. Repeated rows are rows of their own; equal long texts are spliced once. Kept columns
    named as the operator's own come back with ``_in``. Texts of any length are counted whole, over several chunks where they
    are longer than one. An empty table gives an empty result.
    """
    if margin(file) is None:
        chunk = 1 << 31  # nothing proves a splice for such a tokenizer
    elif overlap < 2 * margin(file) or chunk < 2 * overlap:
        raise ValueError("a chunk must hold two overlaps, and an overlap twice the margin")
    common.small_batches(docs.sparkSession)
    counts = whole_counts(docs, file, chunk, keep, text)
    names = counts.columns[: len(keep)]
    longs = docs.where(F.char_length(text) > chunk).select(F.unhex(F.sha2(text, 256)).alias("digest"), F.col(text).alias("text"))
    spliced = spliced_counts(longs, file, chunk, overlap)
    parted = counts.where("digest is not null").drop("n_tokens").join(spliced, "digest")
    rows = counts.where("digest is null").drop("digest").unionByName(parted.drop("digest"))
    return rows.select(*[F.col(f"`{c}`") for c in names], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
