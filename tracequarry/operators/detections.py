"""Run detection rules: many rules in one scan, hits as a long table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EventSet
from ..plans import ast, printer
from ..plans.compile import Compiler, level_rank
from ..plans.errors import QueryError
from ..plans.sigma import Unsupported, compile_rule, simplify
from ..sources.rules import Rule, RuleSet

#: Predicates of one projection, which keeps generated methods small.
BATCH = 64


@dataclass(frozen=True)
class Run:
    """rules(rule, rule_id, title, level, author, license, source, path, state, reason, query, absent, renamed), hits(rule, id, computer, ts_ft), meta."""

    rules: DataFrame
    hits: DataFrame
    meta: dict

    def summary(self) -> DataFrame:
        """Rules with hits, hosts, first and last."""
        own = self.hits.groupBy("rule").agg(F.count("*").alias("hits"), F.count_distinct(F.lower("computer")).alias("hosts"), F.min("ts_ft").alias("first_ft"), F.max("ts_ft").alias("last_ft"))
        return self.rules.join(own, "rule", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("hosts", F.coalesce("hosts", F.lit(0)))

    def hit_events(self) -> DataFrame:
        return self.hits.agg(F.count_distinct("id").alias("n"))

    def by_level(self) -> DataFrame:
        return self.hits.select("rule").distinct().join(self.rules, "rule").groupBy("level").agg(F.count("*").alias("rules"))

    def rules_of_event(self, id: int) -> DataFrame:
        own = self.hits.where(F.col("id") == id).select("rule").distinct()
        return self.rules.join(own, "rule", "left_semi").orderBy(level_rank(F.col("level")).desc_nulls_last(), "title")

    def listed(self, scope: str = "hits", least: str = "", text: str = "") -> DataFrame:
        """Rules of a scope: hits, evaluated, problems or all; from a level on; with a text in the title."""
        rows = self.summary()
        rows = rows.where({"hits": F.col("hits") > 0, "evaluated": F.col("state") == "evaluated", "problems": F.col("state") != "evaluated", "all": F.lit(True)}[scope])
        if least:
            from ..plans.compile import RANK

            rows = rows.where(level_rank(F.col("level")) >= RANK[least])
        if text:
            rows = rows.where(F.contains(F.lower("title"), F.lower(F.lit(text))))
        return rows.orderBy(level_rank(F.col("level")).desc_nulls_last(), "title")


RULE_SCHEMA = "rule int, rule_id string, title string, level string, author string, license string, source string, path string, tags array<string>, references array<string>, state string, reason string, query string, absent array<string>, renamed array<string>, status string"


def run(events: EventSet, rules: RuleSet, batch: int = BATCH) -> Run:
    """Compile all rules, then evaluate those that compile, batch by batch of one base condition, in one plan.

    Rules that fail to load or to compile stay in the table with the reason.
    """
    began, rows, work = time.time(), [], {}
    names = set(events.keys)
    for number, rule in enumerate(rules.rules):
        state, reason, query, absent, renamed = "evaluated", "", "", (), ()
        if rule.failure:
            state, reason = "failed", rule.failure
        else:
            try:
                compiled = compile_rule(rule, names, rules.aliases)
                query = printer.expression(compiled.filter)
                absent, renamed = compiled.absent, compiled.renamed
                checked = Compiler(events)
                for base, rest in compiled.parts:
                    checked.expr(ast.And((base, rest)))
                for base, rest in compiled.parts:
                    if simplify(ast.And((base, rest))) != ast.Const(False):
                        work.setdefault(printer.expression(base), (base, []))[1].append((number, rest))
            except (Unsupported, QueryError) as e:
                state, reason = "unsupported", str(e)
        rows.append((number, rule.id, rule.title, rule.level, rule.author, rule.license, rule.source, rule.path, list(rule.tags), list(rule.references), state, reason, query, list(absent), list(renamed), rule.status))
    spark = events.df.sparkSession
    table = spark.createDataFrame(rows, RULE_SCHEMA)
    hits = None
    computer = events.raw("@Computer")
    for base, own in work.values():
        compiler = Compiler(events)
        keep = compiler.filter(base)
        for lo in range(0, len(own), batch):
            tests = [F.when(compiler.expr(rest), F.lit(number)) for number, rest in own[lo : lo + batch]]
            part = events.df.where(keep).select("id", computer.alias("computer"), events.time.alias("ts_ft"), F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("rules"))
            part = part.where(F.size("rules") > 0).select(F.explode("rules").alias("rule"), "id", "computer", "ts_ft")
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], "rule int, id bigint, computer string, ts_ft bigint")
    else:
        hits = hits.distinct()  # a rule's variants may both hold
    states = [r[10] for r in rows]
    meta = {"rules": len(rows), "evaluated": states.count("evaluated"), "unsupported": states.count("unsupported"), "failed": states.count("failed"), "compile_seconds": round(time.time() - began, 3)}
    return Run(table, hits, meta)


def attach(events: EventSet, found: Run) -> EventSet:
    """Events whose queries may refer to rule and rulelevel."""
    from dataclasses import replace

    return replace(events, rules=found.rules, hits=found.hits)


def rule_by_name(rules: RuleSet, title: str) -> Rule:
    return next(r for r in rules.rules if r.title == title)
