"""Best-fit packing: cut documents into token pieces and pack the pieces into sequences by best-two-fit.

Pieces are spread by hash over shards of about SHARD_ITEMS pieces and each shard is packed on its own, so
a shard's memory is bounded at any input size and a shard wastes about one sequence at its end. Pieces
that fill a sequence by themselves pass through.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END_ID = 1
SHARD_ITEMS = 32_768
TOKENIZER = "word_bpe_49k.json"

PIECES = "piece int, start long, length long, ids_crc32 long"


#: Words, and bytes of words, from which a worker's memory of words falls back to its first KEPT_WORDS, which have the frequent
#: ones; words tokenized by one call.
CACHE_WORDS, CACHE_BYTES, KEPT_WORDS, CALL_WORDS = 400_000, 8 << 20, 150_000, 20_000


class WordTokens(dict):
    """Token ids of texts, word by word.

    The tokenizer lowers case, drops white space, never joins text across it and parts letters from marks. A text's
    ids are thus the ids of its parts between blanks and line ends, and a comma or full stop that ends a part after
    a letter is apart again; each part's ids are kept. Texts that hold "<|" may spell special tokens and keep their case.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.bytes = 0
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def shrink(self) -> None:
        """Forget all but the first words, or all of them if those are long."""
        words = list(islice(self, KEPT_WORDS))
        held = sum(map(len, words))
        if held > CACHE_BYTES // 2:
            return self.reset()
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.bytes, self.starts, self.sizes = held, self.starts[: len(words)], self.sizes[: len(words)]
        ends = np.cumsum(self.sizes)
        self.ids = self.ids[np.repeat(self.starts - (ends - self.sizes), self.sizes) + np.arange(ends[-1])]
        self.starts = ends - self.sizes

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self.bytes += len(word)
        place = self[word] = len(self)
        return place

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def learn(self) -> None:
        """Find the ids of the new words: those of the word without its mark, then the mark's."""
        for lo in range(0, len(self.new), CALL_WORDS):
            words = self.new[lo : lo + CALL_WORDS]
            marks = [w[-1:] if _END.search(w) else b"" for w in words]
            bare = [w[:-1] if m else w for w, m in zip(words, marks, strict=True)]
            known = len(self.sizes)
            places = {w: i for i, w in enumerate(dict.fromkeys([b".", b",", *(w for w in bare if self.get(w, known) >= known)]))}
            ids, sizes = self._tokenize([w.decode() for w in places])
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
            at = [self[w] if w not in places else -1 - places[w] for w in bare]
            own = np.array(at, np.int64)
            fresh = own < 0
            start, size = np.where(fresh, starts[np.where(fresh, -1 - own, 0)], 0), np.where(fresh, sizes[np.where(fresh, -1 - own, 0)], 0)
            if not fresh.all():
                start[~fresh], size[~fresh] = self.starts[own[~fresh]], self.sizes[own[~fresh]]
            if marked := [i for i, m in enumerate(marks) if m]:
                tail = [ids[starts[places[marks[i]]] - len(self.ids) + len(ids) :][: sizes[places[marks[i]]]] for i in marked]
                parts = [np.concatenate([self.ids[start[i] : start[i] + size[i]], t]) for i, t in zip(marked, tail, strict=True)]
                more = np.array([len(x) for x in parts], np.int64)
                start[marked], size[marked] = len(self.ids) + np.cumsum(more) - more, more
                self.ids = np.concatenate([self.ids, *parts])
            self.starts, self.sizes = np.concatenate([self.starts, start]), np.concatenate([self.sizes, size])
        self.new = []

    def _tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another and their counts, many by one call: a word of letters alone has one token that ends words, its last."""
        plain = np.fromiter(map(str.isalpha, words), bool, count=len(words))
        letters = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        ids = self._flat([" ".join(letters[k : k + 500]) for k in range(0, len(letters), 500)])
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(letters) or len(ids) and ends[-1] != len(ids) - 1:  # a word that its lower case parts
            plain[:] = False
            ids, ends = np.empty(0, np.uint32), np.empty(0, np.int64)
        rest = [w for w, p in zip(words, plain.tolist(), strict=True) if not p]
        other = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        sizes = np.empty(len(words), np.int64)
        sizes[plain] = np.diff(np.r_[-1, ends])
        sizes[~plain] = [len(x) for x in other]
        out = np.empty(int(sizes.sum()), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine] = ids
        out[~mine] = np.fromiter(chain.from_iterable(other), np.uint32)
        return out, sizes

    def _flat(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's count."""
        if len(self) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.shrink()
        flat: list[bytes] = []
        many = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = (text if b"<|" in text else text.lower()).replace(b"\n", b" ").split(b" ")
            many[i] = len(own)
            flat += own
        at = np.fromiter(map(self.__getitem__, flat), np.int64, count=len(flat))
        if self.new:
            self.learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(many)]])


_END = re.compile(rb"[a-z][.,]\Z")
_KEPT: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, end each with END_ID, and cut those longer than capacity.

    One row per piece: the kept columns, piece (from 0), start, length, ids_crc32, and ids on request. A
    null or empty text is one piece that holds END_ID alone. Texts of any length are cut whole. Repeated rows give repeated
    pieces, and an empty table none.
    """
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path(TOKENIZER)
    common.small_batches(docs.sparkSession)
    kept, head = common.kept_names(docs, keep, [*common.fields(PIECES), "ids"])

    def start():
        if file not in _KEPT:
            _KEPT[file] = WordTokens(file)
        tokens = _KEPT[file]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, counts = tokens.encode(common.texts(batch.column(len(keep))))
            of, rows, parts, at = [], [], [], 0
            for i, n in enumerate(counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4")
                at += n
                for k in range(-(-len(own) // capacity)):
                    part = own[k * capacity : (k + 1) * capacity]
                    of.append(i)
                    rows.append((k, k * capacity, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part)
            columns = [batch.column(k).take(pa.array(of, pa.int32())) for k in range(len(keep))]
            columns += [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = [*kept, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(common.list_of(parts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

        return step

    return docs.select(*keep, F.col(text)).mapInArrow(common.batches(start), head + PIECES + ", ids array<long>" * with_ids)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Lengths are 1 to capacity.

    A bin takes the longest item that fits until none does. While it has a gap, its smallest item goes
    back if two unpacked items fill the gap and its place more tightly; the tightest such pair is taken.
    Sets of lengths are bits of whole numbers, so that both searches are a few operations.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[i], []).append(i)
    there = mirror = 0
    for n in stacks:
        there |= 1 << n
        mirror |= 1 << capacity - n
    left = {n: len(s) for n, s in stacks.items()}

    def take(n: int) -> None:
        nonlocal there, mirror
        left[n] -= 1
        if not left[n]:
            there ^= 1 << n
            mirror ^= 1 << capacity - n

    def give(n: int) -> None:
        nonlocal there, mirror
        if not left[n]:
            there |= 1 << n
            mirror |= 1 << capacity - n
        left[n] += 1

    out = []
    while there:
        own, gap = [], capacity
        while gap and (fits := there & (2 << gap) - 1):
            n = fits.bit_length() - 1
            take(n)
            own.append(n)
            gap -= n
        while gap and there:
            small = min(own)
            for total in range(gap + small, small, -1):
                pairs = there & mirror >> capacity - total
                a = pairs.bit_length() - 1
                if pairs and (2 * a != total or left[a] > 1):
                    break
            else:
                break
            own.remove(small)
            give(small)
            take(a)
            take(total - a)
            own += [a, total - a]
            gap += small - total
        out.append([stacks[n].pop() for n in own])
    return out


def pack(items: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, shards: int = 1) -> DataFrame:
    """Add sequence_id and offset to items by best-two-fit within shards of hashed items.

    Items are dealt by a hash of the order columns and their length, and sorted by them before packing, so
    a repeated task packs alike; equal items are interchangeable, of equal lengths the
    first in that order is taken, and of pairs of one total the one with the longest item. An item whose length is null, below 1 or
    above capacity gets null sequence_id and offset. An empty table stays empty.
    """
    common.small_batches(items.sparkSession)
    schema = items.schema
    where = schema.fieldNames().index(length)
    dealt = items.repartition(max(1, shards), F.xxhash64(*order, length)).sortWithinPartitions(F.desc(length), *order)

    def start(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 36, 0

        def done(batch: pa.RecordBatch, sequence: pa.Array, offset: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, sequence, offset], names=[*batch.schema.names, "sequence_id", "offset"])

        held = []
        for batch in it:
            n = batch.column(where).to_numpy(zero_copy_only=False).astype(np.float64)
            whole, fits = n == capacity, (n >= 1) & (n < capacity)
            if (alone := ~fits).any():
                ids = np.where(whole, base + used + np.cumsum(whole) - 1, 0)[alone]
                used += int(whole.sum())
                lost = ~whole[alone]
                yield done(batch.filter(pa.array(alone)), pa.array(ids, pa.int64(), mask=lost), pa.array(np.zeros(len(ids), np.int64), mask=lost))
            if fits.any():
                held.append(batch.filter(pa.array(fits)))
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows.column(where).to_pylist()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for k, own in enumerate(best_two_fit(lengths, capacity)):
                at = 0
                for i in own:
                    sequence[i], offset[i] = base + used + k, at
                    at += lengths[i]
            for lo in range(0, len(lengths), 20_000):
                part = rows.slice(lo, 20_000).combine_chunks().to_batches()[0]
                yield done(part, pa.array(sequence[lo : lo + 20_000]), pa.array(offset[lo : lo + 20_000]))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return dealt.mapInArrow(start, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pieces of all documents with their sequence and place; the shards follow the number of documents. Nulls, long texts and
    repeated rows are as in token_pieces; an empty table gives no pieces."""
    shards = -(-docs.count() // shard_items)
    return pack(token_pieces(docs, capacity=capacity), order=("doc_id", "piece", "ids_crc32"), capacity=capacity, shards=shards)


def op2_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
