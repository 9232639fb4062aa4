"""URL filters: fixed rules, and the ratio of two character language models for what no rule decides.

URLs that a rule allows or blocks train two variable-order Markov models over the characters of host and path.
A model interpolates all orders by Witten-Bell: a context seen often trusts its own counts, one seen with many
different successors trusts the shorter context. A URL's score is the log-likelihood difference per
character; the threshold is where the shares of wrong verdicts on both kinds meet, over a fifth of the rule-decided
URLs (by hash) that the models have not seen.
Everything is DataFrame expressions: models are tables of n-grams, joined by n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: (verdict, host, path): fixed by the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of the longest n-gram, so contexts have up to ORDER - 1; symbols that an unseen character is one of.
ORDER, SYMBOLS = 5, 256
#: One of so many distinct URLs, by hash, calibrates the threshold and does not train the models.
HELD_OUT = 5
_PAD, _END = "\u0002", "\u0003"
_ABC = "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; empty without ``://`` and for null."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _ABC.upper(), _ABC), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """Probabilities of rows (gram, na, nb), counts of n-grams of full order in allowed and blocked URLs.

    Returns (gram, pa, pb): the probability of the last character after the others under each model. A context
    never seen passes its shorter context's probability on; with nothing seen all symbols are alike.
    """
    below = None
    for n in range(1, order + 1):
        own = grams.groupBy(F.right("gram", F.lit(n)).alias("gram")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")) if n < order else grams
        context = Window.partitionBy(F.left("gram", F.lit(n - 1)))  # rows: the distinct characters after one context
        rows = own.select("gram", *[f(s).over(context).alias(k + s) for s in ("na", "nb") for k, f in (("c", F.sum), ("t", lambda s: F.count_if(F.col(s) > 0)))], "na", "nb")
        if below is None:
            rows = rows.withColumns({"qa": F.lit(1.0 / SYMBOLS), "qb": F.lit(1.0 / SYMBOLS)})
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            rows = rows.withColumn("suffix", F.right("gram", F.lit(n - 1))).join(lower, "suffix")
        p = lambda s: F.when(F.col("cn" + s) + F.col("tn" + s) > 0, (F.col("n" + s) + F.col("tn" + s) * F.col("q" + s)) / (F.col("cn" + s) + F.col("tn" + s))).otherwise(F.col("q" + s))
        below = rows.select("gram", p("a").alias("pa"), p("b").alias("pb"))
    return below


def held_out() -> Column:
    """Whether a URL, by its host and path, is kept from the models."""
    return F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule, verdict, score and threshold of each url.

    score is null where a rule decides. A URL at or above the threshold is allowed; if no URL held out is of a
    kind, the threshold is 0. Null urls and urls without ``://`` have an empty host and path and are scored as
    the empty string. Equal URLs are counted by their number but scored once, and repeated rows stay. URLs are scored whole,
    however long; a score equal to the threshold is allowed. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "decided": verdict})
    each = common.stored(rows.groupBy("host", "path", "decided").agg(F.count("*").alias("n")), "urls")
    text = F.concat(F.lit(_PAD * (order - 1)), "host", "path", F.lit(_END))
    spots = each.withColumn("s", text).select("host", "path", "decided", "n", F.explode(F.sequence(F.lit(1), F.length("s") - (order - 1))).alias("i"), "s")
    spots = spots.select("host", "path", "decided", "n", F.substring("s", F.col("i"), F.lit(order)).alias("gram"))
    counted = lambda v: F.sum(F.when((F.col("decided") == v) & ~held_out(), F.col("n")).otherwise(0))
    grams = common.stored(spots.groupBy("gram").agg(counted("allow").alias("na"), counted("block").alias("nb")), "grams")
    known = common.stored(model(grams, order).select("gram", (F.log("pa") - F.log("pb")).alias("gain")), "model")
    scores = spots.join(known, "gram").groupBy("host", "path", "decided").agg((F.sum("gain") / F.count("*")).alias("score"), F.first("n").alias("n"))
    scores = common.stored(scores, "scores")
    cut = F.lit(threshold(scores.where(held_out())).first()["threshold"])
    left = scores.where("decided is null").select("host", "path", "score")
    out = rows.join(left, ["host", "path"], "left").withColumn("threshold", cut)
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    names, _ = common.kept_names(pages, keep, ["host", "path", "rule", "verdict", "score", "threshold"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), F.when(F.col("decided").isNull(), F.col("score")).alias("score"), "threshold")


def threshold(scores: DataFrame, steps: int = 200) -> DataFrame:
    """One row: the score at which as large a share of allowed URLs lies below as of blocked URLs above."""
    at = [i / steps for i in range(steps + 1)]
    lows = lambda v, ps: F.percentile_approx(F.when(F.col("decided") == v, F.col("score")), ps, 10_000)
    row = scores.agg(lows("allow", at).alias("a"), lows("block", [1 - x for x in at]).alias("b"))
    meet = F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] >= x["b"])
    first = F.get(meet, 0)
    return row.select(F.coalesce((first["a"] + first["b"]) / 2, F.lit(0.0)).alias("threshold"))


def op10_url_models(spark, sf_dir: str) -> DataFrame:
    """Verdict of every url of pages."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
