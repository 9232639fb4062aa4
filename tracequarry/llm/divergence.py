"""Divergence of sources: how far each source's term shares lie from every other's, by corrections to a baseline.

A term that neither of two sources has adds the same f of their zero-count shares, so each ordered pair starts at V times
that f and only the postings of a term correct it. A posting beside an absent one gives a correction that depends on its
count alone: those are added up by count first. Two postings of one term give the rest. All numbers are integers.

Terms are counted in tasks before anything is shuffled, so a hot source or word is a few rows a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Documents of a language that a term must be in to be kept.
LEAST_DOCS = 3
#: Ranks of terms that a group reports.
RANKS = 200
#: Shares are parts of a thousand million.
UNIT = 1_000_000_000
#: Entries of a task's counters before they are handed on; it saves shuffled rows only.
HELD = 300_000

_COUNTED = "lang string, source string, term string, n long, docs long"
#: ASCII letters in lower case; every other ASCII character parts terms; what lies beyond ASCII stays.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _count() -> object:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            # the row without a term says that the group is there
            terms = [b"", *n]
            yield pa.record_batch(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                names=common.fields(_COUNTED),
            )
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), common.texts(batch["text"]), strict=True):
                n, docs = counts[lang, source]
                terms = text.translate(_LETTERS).split()
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    return run


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) counted within tasks, with a row of the empty term for each group seen."""
    common.small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(lambda it: _count()(it), _COUNTED)


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept postings (lang, source, term, n, in_lang, leads) and groups (lang, source), both from one stored table.

    in_lang is the term's count in its language; leads marks one posting of each term.
    """
    term = Window.partitionBy("lang", "term")
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumns({"in_docs": F.sum("docs").over(term), "in_lang": F.sum("n").over(term), "leads": F.col("source") == F.min("source").over(term)})
    rows = common.stored(rows.where((F.col("term") == "") | (F.col("in_docs") >= LEAST_DOCS)).drop("docs", "in_docs"), "postings")
    return rows.where("term <> ''"), rows.where("term = ''").select("lang", "source")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact beyond 64 bits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(n + 1), F.nullif(whole(total + terms), F.lit(0).cast("decimal(19,0)"))) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_table(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, total, v, lang_total, p0) of each group: its count of kept terms, the language's terms and count, and the share of no occurrence."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count_if("leads").alias("v"), F.sum("n").alias("lang_total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", none("total"), none("v"), none("lang_total"))
    return common.stored(rows.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "groups")


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of a language's sources."""
    c = F.col
    other = groups.select("lang", c("source").alias("item"), c("p0").alias("q0"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (c("v") * F.coalesce(apart(c("p0"), c("q0")), F.lit(0))).alias("value"))

    # a posting beside an absent one, all postings of one count together
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"]).withColumn("p", share(c("n"), c("total"), c("v")))
    alike = alike.join(other, "lang").where("source <> item")
    role = lambda source, item, p, q, p0, q0: F.struct(c(source).alias("source"), c(item).alias("item"), (c("m") * (apart(c(p), c(q)) - apart(c(p0), c(q0)))).alias("value"))
    single = alike.select("lang", F.inline(F.array(role("source", "item", "p", "q0", "p0", "q0"), role("item", "source", "q0", "p", "q0", "p0"))))

    # two postings of a term, beyond what each gives alone
    rows = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", share(c("n"), c("total"), c("v")).alias("p"), "p0")
    there = rows.select("lang", "term", c("source").alias("item"), c("p").alias("q"), c("p0").alias("q0"))
    more = apart(c("p"), c("q")) - apart(c("p"), c("q0")) - apart(c("p0"), c("q")) + apart(c("p0"), c("q0"))
    both = rows.join(there, ["lang", "term"]).where("source <> item").select("lang", "source", "item", more.alias("value"))

    parts = base.union(single.where("value <> 0")).union(both.where("value <> 0"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has oftener than its language."""
    c = F.col
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", c("term").alias("item"), share(c("n"), c("total"), c("v")).alias("p"), share(c("in_lang"), c("lang_total"), c("v")).alias("q"))
    return rows.where("p > q").select("lang", "source", "item", apart(c("p"), c("q")).alias("value"))


def divergence(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` ranks a source's language mates, part ``term`` its terms to ``ranks``.

    Null text, language and source are empty. Every group that occurs is there, without terms too; a language without kept
    terms has pairs of value 0. Repeated rows are documents of their own. Ties rank by item in UTF-8 order. Long texts are
    counted whole. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    kept, groups = postings(docs)
    groups = group_table(kept, groups)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, terms = (df.withColumn("rank", F.row_number().over(ranked)) for df in (pair_values(kept, groups), term_values(kept, groups)))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").union(part(terms.where(F.col("rank") <= ranks), "term"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Sources of all documents against each other, and their terms against their language's."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
