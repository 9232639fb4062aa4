"""Quality rules: document statistics, fixed rules, and gradient-boosted trees with monotonic constraints.

The trees are fitted on the driver over a bounded sample of labelled documents (SAMPLE, the smallest hashes
of doc_id) and flattened into numpy node arrays, which score whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST, L2 = 60, 3, 0.2, 64, 10, 1.0
#: A document is kept from this probability of good quality on.
KEEP = 0.3
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEAT = 50, 50

#: Features of the trees; 1: quality may only rise with it, -1: only fall, 0: free.
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": -1,
    "mark_share": 0, "words_per_line": 0, "longest_word": 0, "bar_share": -1, "exclaim_share": -1,
}

_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"


def statistics(text: str, hashes: common.WordHashes, weights: np.ndarray) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    chars = len(text) - blanks
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    h = hashes.of(words)
    runs = common.rolling(h, 3, weights)
    repeat = 0
    if len(runs):
        _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : k + len(twice)] |= twice
            repeat = int(hit.sum())
    share = lambda x, y: x / y if y else 0.0
    without = lambda c: len(raw) - len(raw.translate(None, c))
    upper = without(_UPPER)
    features = [
        n, share(chars, n), share(symbols, chars), share(dup, len(lines)), share(repeat, n), share(len(np.unique(h)), n), share(upper, chars), share(without(_DIGIT), chars),
        share(without(b".,;:?\"'()-"), chars), share(n, len(lines)), max(map(len, words), default=0), share(raw.count(b"|"), n), share(raw.count(b"!"), n),
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """Node arrays of full binary trees: feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2 ** depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.base), int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (v.shape[0] - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for the logistic loss by histograms of BINS quantile bins.

    A split on a constrained feature must order its two leaves by the sign, and both sides are then held on
    their side of the middle, so the whole sum is monotonic. With one class or no rows there are no trees.
    """
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.empty((0, 0), int), np.empty((0, 0)), np.empty((0, 0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, inner = np.full(len(y), base), 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t, v = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        bounds = {0: (-np.inf, np.inf)}
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            lo, hi = bounds[k]
            here = np.flatnonzero(node == k)
            best, both = None, (lo, hi)
            if len(here) >= 2 * LEAST:
                gs, hs = g[here].sum(), h[here].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = bins[here, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[here], h[here], None))
                    left, right = np.clip(-gl / (hl + L2), lo, hi), np.clip(-(gs - gl) / (hs - hl + L2), lo, hi)
                    worth = -(gl * left + 0.5 * (hl + L2) * left**2 + (gs - gl) * right + 0.5 * (hs - hl + L2) * right**2)
                    ok = (nl >= LEAST) & (len(here) - nl >= LEAST) & (signs[j] * (right - left) >= 0)
                    worth = np.where(ok, worth, -np.inf)
                    at = int(worth.argmax())
                    if worth[at] > -np.inf and (best is None or worth[at] > best[0] + 1e-12):
                        best = (worth[at], j, at, left[at], right[at])
            bounds[2 * k + 1] = bounds[2 * k + 2] = both
            if best:
                _, j, at, left, right = best
                f[k], t[k], middle = j, cuts[j][at], (left + right) / 2
                if signs[j]:
                    bounds[2 * k + 1 if signs[j] > 0 else 2 * k + 2] = (lo, middle)
                    bounds[2 * k + 2 if signs[j] > 0 else 2 * k + 1] = (middle, hi)
            node[here] = 2 * k + 1 + (x[here, f[k]] > t[k])
        for leaf in range(inner + 1):
            here = node == inner + leaf
            v[leaf] = rate * np.clip(-g[here].sum() / (h[here].sum() + L2), *bounds[inner + leaf]) if here.any() else 0.0
            if not here.any() and np.isfinite(bounds[inner + leaf]).any():
                v[leaf] = rate * float(np.clip(0.0, *bounds[inner + leaf]))
        margin += v[node - inner]
        features.append(f), thresholds.append(t), values.append(v)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_stats(df: DataFrame, text: str, keep: tuple[str, ...], model: Trees | None = None) -> DataFrame:
    """The kept columns, the five counts, the features as an array, and the model's probability (null without one).

    Texts are read whole, however long; a null or empty one has no words. Repeated rows give repeated results, and an empty table an empty one.
    """
    common.small_batches(df.sparkSession)
    kept, head = common.kept_names(df, keep, [*common.fields(STATS), "features", "quality", "base_failed", "kept"])

    def start():
        hashes, weights = common.WordHashes(), common.odd_weights(3)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            got = [statistics(t or "", hashes, weights) for t in batch.column(len(keep)).to_pylist()]
            x = np.array([f for _, f in got], np.float64)
            columns = [pa.array(c, pa.int64()) for c in zip(*(s for s, _ in got), strict=True)]
            p = pa.nulls(len(got), pa.float64()) if model is None else pa.array(model.probability(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *columns, common.list_of(list(x), pa.float64()), p], names=[*kept, *common.fields(STATS), "features", "quality"])

        return step

    return df.select(*keep, F.col(text)).mapInArrow(common.batches(start), head + STATS + ", features array<double>, quality double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees for labels.quality over a sample of labelled documents; None without any label.

    A doc_id with several labels counts as bad if one is bad. The sample is the doc_ids with the smallest
    hashes, so it does not depend on partitioning, and it is small enough to broadcast at any input size.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = document_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", ("doc_id", "good")).select("doc_id", "good", "features")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).toPandas()
    if got.empty:
        return None
    return fit(np.stack(got["features"].to_numpy()), got["good"].to_numpy().astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = KEEP, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """Counts, base_failed, quality and kept of each document, with the columns in keep.

    A null text has no words, so it fails. Without labels there is no model and the base rules decide. Texts are read whole,
    however long. A probability equal to the threshold is kept. Repeated rows give repeated results, and an empty table an
    empty one. Kept columns named as the operator's own come back with ``_in``.
    """
    rows = document_stats(docs, text, keep, train(docs, labels, sample))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("quality") >= threshold, F.lit(True))).drop("features")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns under their own names; null and empty texts go. An empty table gives an empty one."""
    judged = judge(docs, labels, tuple(docs.columns))
    names = judged.columns[: len(docs.columns)]
    return judged.where("kept").select(*[F.col(f"`{a}`").alias(c) for a, c in zip(names, docs.columns, strict=True)])


def op9_boosted(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
