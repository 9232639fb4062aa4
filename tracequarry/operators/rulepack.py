"""A whole rule pack at once: its literals are a table that meets the distinct values of each field, not an expression for each rule.

1. Every rule becomes a sparse expression: atoms (a value of the event has one of some patterns), tests (on the event itself)
   and nodes (all of some parts hold and none of others). Negation is pushed to places beside something that holds, so that
   only what is true needs rows.
2. Distinct values of the fields, counted, meet the patterns: equal ones by their lower case, others by a run of up to three
   characters that few patterns have, and then the pattern itself is tried. So it is known how many events an atom has, and
   parts that need an atom without any are dropped with their rules.
3. The atoms of values are joined back to the events, one row of true parts for each event, and nodes follow level by level:
   a node is tried where its rarest part holds, within the row.

The events are read twice, whatever the number of rules: for their values, and for the join. Tables made of the rules are as
large as the pack and do not grow with the events; nor do the counts of atoms, which come to the driver.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import text as X
from ..model import EventSet, Key
from ..plans import ast, printer
from ..plans.compile import Compiler, resolve
from ..plans.errors import QueryError
from ..plans.sigma import Unsupported, compile_rule
from ..sources.rules import RuleSet
from ..stages import stored
from .detections import RULE_SCHEMA, Run

#: Key of patterns that any field may have.
ANY = ""
#: Lengths of the runs that patterns and values meet on, best first.
GRAMS = (3, 2, 1)
_MASK = {"contains": "contains", "startswith": "startswith", "endswith": "endswith"}

#: More events than any atom has: what is not counted is tried last.
MANY = 1 << 62

Pattern = tuple[str, str, str]  # key, kind, text


def grams(text: str) -> set[str]:
    """Runs of the best length that the text has, of ASCII characters alone: those look alike in any way of making lower case."""
    for n in GRAMS:
        if found := {g for i in range(len(text) - n + 1) if (g := text[i : i + n]).isascii()}:
            return found
    return set()


def literal_of(kind: str, text: str) -> str:
    """The longest run of a pattern that its values must hold, in lower case."""
    low = text.lower()
    return max(re.split(r"[*?]+", low), key=len) if kind == "like" else low


class Pack:
    """The parts of all rules, numbered; ``levels`` has the nodes (node, needed parts, others) by how many levels are below them."""

    def __init__(self, events: EventSet) -> None:
        self.events, self.compiler, self.ids = events, Compiler(events), {}
        self.patterns: dict[Pattern, int] = {}
        self.scans: dict[tuple[str, ast.Expr], tuple[int, Column]] = {}  # on ``value`` of a key
        self.on_key: dict[str, Compiler] = {}
        self.members: set[tuple[int, int]] = set()  # pattern, atom
        self.tests: dict[int, Column] = {}
        self.levels: dict[int, list[tuple]] = {}
        self.level: dict[int, int] = {}

    def number(self, what, level: int) -> tuple[int, bool]:
        new = what not in self.ids
        at = self.ids.setdefault(what, len(self.ids))
        self.level[at] = level
        return at, new

    # leaves

    def key(self, name: str) -> Key | None:
        found = resolve(self.events, name)
        return None if isinstance(found, str) or found.name.startswith("@") else found

    def on_values(self, e: ast.Expr) -> list[Pattern | tuple[str, ast.Expr]] | None:
        """What a value must be for a leaf to hold, one of a list; None where the event decides."""
        if isinstance(e, ast.Text):
            return [(ANY, "contains", e.value)] if grams(e.value.lower()) else None
        if isinstance(e, ast.In) and not e.negated:
            key = self.key(e.field)
            return None if key is None else [self.equal(key.name, v) for v in e.values]
        if not isinstance(e, ast.Cond) or (key := self.key(e.field)) is None or e.op in ("!=", "not contains"):
            return None
        name, op, value = key.name, e.op, e.value
        if op == "=" or op == "==" and X.has_mask(value):
            return [self.equal(name, value)]
        if op == "==":
            return [(name, "exact", value)]
        if op in (*_MASK, "like"):
            if not value:
                return []
            return [(name, op, value) if grams(literal_of(op, value)) else (name, ast.Cond(name, op, value))]
        if op == "cidr":
            net.network(value)  # says what is wrong with it
            return [(name, "cidr", value)]
        if op in ("<", "<=", ">", ">=") and key.number is not None:
            return None
        return [(name, ast.Cond(name, op, value))]

    def equal(self, name: str, value: str) -> Pattern | tuple[str, ast.Expr]:
        if not X.has_mask(value):
            return name, "equal", value
        return (name, "like", value) if grams(literal_of("like", value)) else (name, ast.Cond(name, "like", value))

    def atom(self, wanted: list) -> int:
        own = frozenset(self.pattern(w) for w in wanted)
        at, new = self.number(("atom", own), 0)
        if new:
            self.members |= {(p, at) for p in own}
        return at

    def pattern(self, wanted) -> int:
        count = len(self.patterns) + len(self.scans)
        if len(wanted) == 3:
            return self.patterns.setdefault(wanted, count)
        if wanted not in self.scans:
            key = wanted[0]
            if key not in self.on_key:
                self.on_key[key] = Compiler(EventSet(self.events.df, {key: Key(key, F.col("value"))}))
            self.scans[wanted] = count, self.on_key[key].expr(wanted[1])
        return self.scans[wanted][0]

    def test(self, e: ast.Expr) -> int:
        at, new = self.number(("test", e), 0)
        if new:
            self.tests[at] = self.compiler.expr(e)
        return at

    # expressions

    def sparse(self, e: ast.Expr) -> tuple[bool, int]:
        """Whether an expression is a part, or holds where the part does not."""
        if isinstance(e, ast.Not):
            sign, at = self.sparse(e.item)
            return not sign, at
        if isinstance(e, ast.Exists) and e.negated:
            return False, self.test(ast.Exists(e.field))
        if isinstance(e, ast.In) and e.negated:
            sign, at = self.sparse(ast.In(e.field, e.values))
            return not sign, at
        if isinstance(e, ast.And):
            return self.all_of([self.sparse(x) for x in e.items])
        if isinstance(e, ast.Or):
            wanted = [(x, self.on_values(x)) for x in e.items]
            parts = [self.sparse(x) for x, w in wanted if w is None]
            if own := [w for _, w in wanted if w is not None]:
                parts.append((True, self.atom([p for w in own for p in w])))
            sign, at = self.all_of([(not s, a) for s, a in parts])
            return not sign, at
        wanted = self.on_values(e)
        return True, self.test(e) if wanted is None else self.atom(wanted)

    def all_of(self, parts: list[tuple[bool, int]]) -> tuple[bool, int]:
        need, ban = frozenset(a for s, a in parts if s), frozenset(a for s, a in parts if not s)
        if not need:  # none of some: not one of them
            return (False, next(iter(ban))) if len(ban) == 1 else (False, self.node(frozenset(), ban))
        if len(need) == 1 and not ban:
            return True, next(iter(need))
        return True, self.node(need, ban)

    def node(self, need: frozenset[int], other: frozenset[int]) -> int:
        """All needed parts and none of the others; without needed ones, one of the others."""
        level = 1 + max(self.level[a] for a in need | other)
        at, new = self.number(("node", need, other), level)
        if new:
            self.levels.setdefault(level, []).append((at, need, other))
        return at

    def drivers(self, often: dict[int, int]) -> dict[int, list[tuple]]:
        """Rows (part, node, need, ban) by level: a node is tried where its rarest part holds. ``often`` has the events of atoms.

        Nodes that cannot hold are left out.
        """
        known = {at: often.get(at, 0) for what, at in self.ids.items() if what[0] == "atom"}
        known |= dict.fromkeys(self.tests, MANY)
        out = {}
        for level, nodes in sorted(self.levels.items()):
            rows = []
            for at, need, other in nodes:
                if need:
                    driver = min(need, key=lambda a: (known[a], a))
                    known[at] = known[driver]
                    if known[at]:
                        rows.append((driver, at, sorted(need - {driver}), sorted(a for a in other if known[a])))
                else:
                    known[at] = sum(known[a] for a in other)
                    rows += [(a, at, [], []) for a in sorted(other) if known[a]]
            if rows:
                out[level] = rows
        return out

    def keys(self) -> list[Key]:
        """Fields whose values are read."""
        names = {p[0] for p in self.patterns} | {k for k, _ in self.scans}
        return [k for n, k in sorted(self.events.keys.items()) if ANY in names or n in names]


def _grams(low: Column, lengths: list[int]) -> Column:
    """Distinct runs of these lengths of a text."""
    letters = F.split(low, "")

    def runs(n: int) -> Column:
        count = F.char_length(low) - n
        places = F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)]))

    return F.array_distinct(F.concat(*map(runs, lengths)))


def _pairs(pack: Pack) -> Column:
    """The event's distinct values as an array of (key, value)."""
    pair = lambda name: lambda v: F.struct(F.lit(name).alias("key"), v.alias("value"))
    own = [F.transform(F.array_distinct(k.text) if k.many else F.array(k.text), pair(k.name)) for k in pack.keys()]
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(F.concat(*[F.coalesce(a, none) for a in own]), lambda p: p["value"].isNotNull()) if own else none


def matches(pack: Pack, values: DataFrame) -> DataFrame:
    """(key, value, atoms) of the values that have patterns."""
    spark = values.sparkSession
    values = values.withColumn("low", F.lower("value"))
    found = []
    plain = [(i, k, kind, t) for (k, kind, t), i in pack.patterns.items() if kind in ("equal", "exact")]
    if plain:
        wanted = spark.createDataFrame(plain, "pattern int, key string, kind string, text string").withColumn("low", F.lower("text"))
        found.append(values.join(wanted, ["key", "low"]).where("kind = 'equal' or value = text").select("key", "value", "pattern"))
    subnets = [(i, k, text) for (k, kind, text), i in pack.patterns.items() if kind == "cidr"]
    if subnets:
        of_key = spark.createDataFrame([(i, k) for i, k, _ in subnets], "net int, key string")
        within = net.in_networks(values.where(F.col("key").isin(*{k for _, k, _ in subnets})), "value", [(i, text) for i, _, text in subnets])
        found.append(within.join(of_key, ["net", "key"]).select("key", "value", F.col("net").alias("pattern")))
    parts = [(p, i, literal_of(*p[1:])) for p, i in pack.patterns.items() if p[1] not in ("equal", "exact", "cidr")]
    if parts:
        often = Counter(g for _, _, run in parts for g in grams(run))
        rows = [(min(grams(run), key=lambda g: (often[g], g)), i, k, kind, X.like_pattern(t.lower()) if kind == "like" else t) for (k, kind, t), i, run in parts]
        wanted = spark.createDataFrame(rows, "gram string, pattern int, own string, kind string, text string").withColumn("text", F.when(F.col("kind") == "like", F.col("text")).otherwise(F.lower("text")))
        low, text, kind = F.col("low"), F.col("text"), F.col("kind")
        holds = F.when(kind == "contains", F.contains(low, text)).when(kind == "startswith", F.startswith(low, text)).when(kind == "endswith", F.endswith(low, text)).otherwise(F.expr("low LIKE text"))
        each = values.select("key", "value", "low", F.explode(_grams(F.col("low"), sorted({len(r[0]) for r in rows}))).alias("gram")).join(wanted, "gram")
        found.append(each.where(F.col("own").isin(ANY) | (F.col("own") == F.col("key"))).where(holds).select("key", "value", "pattern"))
    tests_of: dict[str, list] = {}
    for (k, _), test in pack.scans.items():
        tests_of.setdefault(k, []).append(test)
    for k, own in tests_of.items():
        for lo in range(0, len(own), 64):
            tests = F.array(*[F.when(holds, F.lit(i)) for i, holds in own[lo : lo + 64]])
            found.append(values.where(F.col("key") == k).select("key", "value", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("pattern")))
    members = spark.createDataFrame(sorted(pack.members), "pattern int, atom int")
    if not found:
        return values.select("key", "value", F.array(F.lit(0)).alias("atoms")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.join(members, "pattern").groupBy("key", "value").agg(F.collect_set("atom").alias("atoms"))


def _looked_up(parts: str, count: int, rows: list[tuple], kind: str) -> Column:
    """What a table of the pack, rows (part, ...), says of the parts of an event, one after another: a constant looked up by number."""
    of: list[list] = [[] for _ in range(count)]
    names = [x.split()[0] for x in kind.split(", ")]
    for part, *rest in rows:
        of[part].append(dict(zip(names, rest, strict=True)))
    shape = ", ".join(x.replace(" ", ":", 1) for x in kind.split(", "))
    table = F.from_json(F.lit(json.dumps(of)), f"array<array<struct<{shape}>>>")
    return F.flatten(F.transform(parts, lambda p: F.get(table, p)))


def true_parts(pack: Pack, all_events: bool) -> DataFrame:
    """(id, computer, ts_ft, parts) of the events, or of those where any holds: numbers of the atoms, tests and nodes that hold."""
    events, spark = pack.events, pack.events.df.sparkSession
    tests = F.filter(F.array(*[F.when(holds, F.lit(i)) for i, holds in pack.tests.items()]).cast("array<int>"), lambda x: x.isNotNull())
    base = pack.compiler.base()
    values = stored(events.df.select(F.inline(_pairs(pack))).groupBy("key", "value").agg(F.count("*").alias("n")), "values")
    found = stored(matches(pack, values.drop("n")), "matches")
    counts = found.join(values, ["key", "value"]).select(F.explode("atoms").alias("atom"), "n").groupBy("atom").agg(F.sum("n").alias("n"))
    drivers_of = pack.drivers({r["atom"]: r["n"] for r in counts.collect()})
    none = F.lit(None).cast("array<int>").alias("own")
    # the event's own row bears its id as value, so that these rows spread like all others
    own = F.array(F.struct(F.lit("\0").alias("key"), F.col("id").cast("string").alias("value"), tests.alias("own")))
    each = F.concat(F.transform(_pairs(pack), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), none)), own)
    rows = base.select("id", events.raw("@Computer").alias("computer"), events.time.alias("ts_ft"), F.inline(each)).join(found, ["key", "value"], "left")
    rows = rows.where("atoms is not null or " + ("own is not null" if all_events else "size(own) > 0"))
    state = rows.groupBy("id").agg(F.max("computer").alias("computer"), F.max("ts_ft").alias("ts_ft"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("atoms", "own")))).alias("parts"))
    for _, nodes in sorted(drivers_of.items()):
        tried = _looked_up("parts", len(pack.ids), nodes, "node int, need array<int>, ban array<int>")
        holds = lambda n: F.forall(n["need"], lambda p: F.array_contains("parts", p)) & ~F.exists(n["ban"], lambda p: F.array_contains("parts", p))
        new = F.transform(F.filter(tried, holds), lambda n: n["node"])
        state = state.withColumn("parts", F.concat("parts", F.array_distinct(new)))
    return state


def run(events: EventSet, rules: RuleSet) -> Run:
    """All rules of a pack over all events; the same rules and hits as ``detections.run``.

    Events without any of the fields, repeated values and nulls are as there; an empty pack or table has no hits.
    """
    began, rows, tops, never = time.time(), [], [], []
    names, pack = set(events.keys), Pack(events)
    for number, rule in enumerate(rules.rules):
        state, reason, query, absent, renamed = "evaluated", "", "", (), ()
        if rule.failure:
            state, reason = "failed", rule.failure
        else:
            try:
                compiled = compile_rule(rule, names, rules.aliases)
                query, absent, renamed = printer.expression(compiled.filter), compiled.absent, compiled.renamed
                if isinstance(compiled.filter, ast.Const):
                    if compiled.filter.value:
                        never.append((number, -1))
                else:
                    sign, part = pack.sparse(compiled.filter)
                    (tops if sign else never).append((number, part))
            except (Unsupported, QueryError) as e:
                state, reason = "unsupported", str(e)
        rows.append((number, rule.id, rule.title, rule.level, rule.author, rule.license, rule.source, rule.path, list(rule.tags), list(rule.references), state, reason, query, list(absent), list(renamed), rule.status))
    spark = events.df.sparkSession
    states = [r[10] for r in rows]
    meta = {"rules": len(rows), "evaluated": states.count("evaluated"), "unsupported": states.count("unsupported"), "failed": states.count("failed"), "compile_seconds": round(time.time() - began, 3)}
    parts = true_parts(pack, bool(never))
    own = _looked_up("parts", len(pack.ids), [(part, number) for number, part in tops], "rule int")
    hits = parts.select("id", "computer", "ts_ft", F.explode(F.transform(own, lambda r: r["rule"])).alias("rule")).select("rule", "id", "computer", "ts_ft")
    if never:  # rules that hold where a part does not
        wanted = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("part")) for r, p in never])
        rest = parts.select("id", "computer", "ts_ft", "parts", F.inline(wanted)).where(~F.array_contains("parts", F.col("part")))
        hits = hits.unionByName(rest.select("rule", "id", "computer", "ts_ft"))
    return Run(spark.createDataFrame(rows, RULE_SCHEMA), hits, meta)
