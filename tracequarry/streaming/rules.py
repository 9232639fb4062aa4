"""Rules over a stream: their filters hold no state, so they run on readStream as they are."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EventSet
from ..sources.rules import RuleSet


def screened(events: EventSet, rules: RuleSet) -> tuple[list[Column], dict[int, str]]:
    """Conditions of the rules that a stream can run, each giving the rule's number, and why each other rule is left out."""
    from ..plans import ast
    from ..plans.compile import Compiler
    from ..plans.errors import QueryError
    from ..plans.sigma import Unsupported, compile_rule

    tests, left_out = [], {}
    for number, rule in enumerate(rules.rules):
        if rule.failure:
            left_out[number] = rule.failure
            continue
        try:
            compiled = compile_rule(rule, set(events.keys), rules.aliases)
            compiler = Compiler(events)
            condition = compiler.expr(compiled.filter)
        except (Unsupported, QueryError) as e:
            left_out[number] = str(e)
            continue
        if compiler.flags:
            left_out[number] = "refers to entities, tags or rules of a stored case"
        elif compiled.filter == ast.Const(False):
            left_out[number] = "no event has its fields"
        else:
            tests.append(F.when(condition, F.lit(number)))
    return tests, left_out


def hits(events: EventSet, rules: RuleSet) -> DataFrame:
    """Hits of a streaming EventSet: rule, id, computer, ts_ft. Warns of rules that are left out; screened() says why."""
    tests, left_out = screened(events, rules)
    if left_out:
        warnings.warn(f"{len(left_out)} of {len(rules.rules)} rules are left out: " + "; ".join(f"{rules.rules[k].title or k}: {why}" for k, why in left_out.items()), stacklevel=2)
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<int>")
    return events.df.select("id", events.raw("@Computer").alias("computer"), events.time.alias("ts_ft"), F.explode(found).alias("rule"))


def counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and key; rows later than the watermark are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("count"))


