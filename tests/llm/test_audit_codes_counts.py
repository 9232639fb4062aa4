"""Source divergence, vector codes and token counts against brute force, with nulls, empty and long texts, ties and copies."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import divergence, tokencounts, vectorcodes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, ranks):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in in_docs.items() if n >= 3]
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if in_docs[t] >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Ab", "ab", "éa", "É", "zz", "q", "日本", "x1y", "don't", "İ", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]]
    rows = [(rng.choice(("en", "de", None)), rng.choice(("a", "a", "a", "b", None, "é", "c")), " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 40))))) for _ in range(120)]
    rows += [("en", "only", None), ("fr", "a", "one two three"), ("fr", "b", ""), ("xx", None, "12 !"), ("en", "long", " ".join(words * 3000)), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit("x"), "docs": F.lit(None).cast("int")}).repartition(5)
    for ranks in (200, 3):
        got = sorted(tuple(r) for r in divergence.divergence(docs, ranks).collect())
        assert got == plain_divergence(rows, ranks)
    assert [t for t in divergence.divergence(docs).dtypes][4:] == [("value", "bigint"), ("rank", "int")]
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_shares_beyond_64_bits(spark):
    n, total, v = 9_000_000_000_000, 90_000_000_000_000, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p"), divergence.share(F.col("n"), F.lit(0), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v) and row["none"] is None


def plain_codes(rows, rounds=6, entries=16, parts=8):
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max([len(v) for _, _, v in kept] + [1]) // parts)
    kept = [(i, l, [(v + [0] * (wide * parts))[p * wide : (p + 1) * wide] for p in range(parts)]) for i, l, v in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(r[2][p]) for r in start] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, x: min((dist(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for r in kept:
                own[best(p, r[2][p])[1]].append(r[2][p])
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, x in kept:
        found = [best(p, x[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), min(sum(min(d, 2**63 - 1) for d, _ in found), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"pos": F.lit("x"), "code": F.lit(1)}).repartition(3)
    found, books = vectorcodes.compressed(df)
    return [tuple(r) for r in found.select("vec_id", "label", "code", "error").collect()], vectorcodes.books_digest(books)


def test_codes_against_brute_force(spark):
    rng = random.Random(2)
    single = lambda x: float(np.float32(x))
    vector = lambda: [single(rng.choice((rng.gauss(0, 1), 0.5, -0.25))) for _ in range(16)]
    rows = [(rng.randrange(1000), vector(), rng.choice((1, 2, None))) for _ in range(150)]
    common = vector()
    rows += [(2000 + i, common, 3) for i in range(60)] + [rows[0], rows[0], (None, vector(), 1), (None, vector(), 1)]
    rows += [(1, None, 1), (2, [None] + [1.0] * 15, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1), (5, [], 2), (6, [1.0, -2.0], 2)]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    want, digest = plain_codes(rows)
    got, own = codes(spark, rows)
    assert sorted(got, key=key) == sorted(want, key=key) and own == digest


def test_codes_of_few_and_of_huge_vectors(spark):
    rows = [(i, [x] * 8, None) for i, x in enumerate((1.0, 2.0**40, -(2.0**40), 3.0))]
    got, digest = codes(spark, rows)
    want, own = plain_codes(rows)
    assert sorted(got) == sorted(want) and digest == own
    assert codes(spark, [(1, None, 1)])[0] == []


def test_label_errors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(8)], rng.choice((1, 2, None))) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectorcodes.op12_vector_codes(spark, str(tmp_path)).collect()
    want, digest = plain_codes([(r[0], [float(np.float32(x)) for x in r[1]], r[2]) for r in rows])
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == sorted((i, c, e, sums[l], digest) for i, l, c, e in want)


@pytest.fixture(scope="module")
def file():
    return pytest.importorskip("public_tokenizers").path(tokencounts.TOKENIZER)


def texts(seed, n=60):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n\n\n", "\t \n", "<|endoftext|>", "<|endof", "'s", "'re", "don't", "1234567890", "é", "日本語", "🙂🙂", "!?!", "word", "Another", "a" * 90, " " * 120, "x1y2", " ", "　 "]
    return ["".join(rng.choice(parts) for _ in range(rng.choice((3, 40, 400)))) for _ in range(n)]


def test_counts_against_the_library(spark, file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(file)
    long_word, blanks = "a" * 5000, " " * 4000
    rows = texts(4) + ["", None, long_word, blanks, "word " * 3000, f"start {long_word} middle {long_word} end {blanks}x" * 2, "<|endoftext|>" * 300, "日" * 3000]
    rows += [rows[-3]] * 12 + [rows[0]] * 3
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "digest": F.lit(2)}).repartition(4)
    got = tokencounts.token_counts(docs, file, limit=100, chunk=128, overlap=48, keep=("doc_id", "n_tokens")).collect()
    want = Counter()
    for i, t in enumerate(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i if i % 7 else None, len((t or "").encode()), n, n > 100)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert {r["n_tokens_in"] for r in got} == {"x"}


def test_overlaps_are_widened(spark, file):
    """A word longer than its chunks leaves no splice; only the cuts within it go."""
    text = "some words here " * 20 + "b" * 700 + " and more words" * 20
    longs = spark.createDataFrame([(b"d", text)], "digest binary, text string")
    none = F.lit(None).cast("array<int>")
    facts = tokencounts.facts_of(tokencounts.chunk_rows(longs.select("digest", "text", none.alias("gone"), none.alias("fresh")), 128, 48), file, 128, 48).withColumn("round", F.lit(0))
    found = {r["cut"]: r["more"] for r in tokencounts.seams(facts, facts.select("digest", "cut").limit(0)).collect()}
    torn = {k for k, v in found.items() if v is None}
    assert torn and torn <= set(range(2, 9)) and len(found) > len(torn) + 3
    from tokenizers import Tokenizer

    assert tokencounts.spliced_counts(longs, file, 128, 48).first()["n_tokens"] == len(Tokenizer.from_file(file).encode(text).ids)


def test_no_proof_no_splice(spark, file):
    """A tokenizer whose words do not come from a scan alone is asked for whole texts; an empty table gives nothing."""
    other = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert tokencounts.margin(other) is None
    docs = spark.createDataFrame([(1, "Many Words " * 50)], "doc_id long, text string")
    assert tokencounts.token_counts(docs, other, chunk=64).first()["n_tokens"] == len(Tokenizer.from_file(other).encode("Many Words " * 50, add_special_tokens=False).ids)
    empty = tokencounts.token_counts(docs.limit(0), file)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
