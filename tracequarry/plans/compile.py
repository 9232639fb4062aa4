"""Compile a filter to a two-valued Column over an EventSet.

Every leaf is true or false, never null, so that not and != include events without the field. A leaf over several
values is true if any value passes. Query text only ever becomes literals. Conditions on entities, tags and rules
join flags of events to the base first; compile returns the base with those flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions import text as X
from ..functions.regexguard import guarded, matches, valid
from ..functions.timeparse import SECOND, parse_time
from ..model import ALIASES, LEVELS, EventSet, Key, mask_test
from . import ast
from .errors import QueryError

TIME = frozenset(("time", "timestamp", "timecreated", "@time"))
ENTITIES = {"anyhost": "host", "anyuser": "user", "anyip": "ip", "@hostentity": "host", "@userentity": "user", "@ipentity": "ip"}
TAGS = frozenset(("tag", "bookmark", "@tag"))
RULES, RULE_LEVELS = frozenset(("rule", "@rule")), frozenset(("rulelevel", "@rulelevel"))
#: Ranks of rule levels, and short spellings.
RANK = {"informational": 1, "info": 1, "low": 2, "medium": 3, "med": 3, "high": 4, "critical": 5, "crit": 5}
#: Lists beyond this length are a join instead of an expression.
LONG_LIST = 500


def resolve(events: EventSet, name: str) -> str | Key:
    """time, host, user, ip, tag, rule, rulelevel, or a key.

    Order: time, entities, tags, @rule, the exact field, rule, aliases, a field in another case.
    """
    low = name.lower()
    if low in TIME:
        return "time"
    if low in ENTITIES:
        return ENTITIES[low]
    if low in TAGS and (low != "tag" or name not in events.keys):
        return "tag"
    if low in ("@rule", "@rulelevel"):
        return low[1:]
    if name in events.keys:
        return events.keys[name]
    if low in RULES or low in RULE_LEVELS:
        return low
    if (alias := ALIASES.get(low)) and alias in events.keys:
        return events.keys[alias]
    for key in sorted(events.keys):
        if key.lower() == low:
            return events.keys[key]
    near = [k for k in sorted(events.keys) if low.lstrip("@") in k.lower()][:5]
    raise QueryError("unknown-field", f"there is no field {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def key_of(events: EventSet, name: str, use: str) -> Key:
    found = resolve(events, name)
    if isinstance(found, str):
        raise QueryError("field-use", f"{name} cannot be used in {use}")
    return found


class Compiler:
    def __init__(self, events: EventSet, zone: str = "UTC", regex_budget: float | None = None) -> None:
        """regex_budget: seconds that a regular expression may take on one value, which then is matched once per distinct value."""
        self.events, self.zone, self.flags, self.bare, self.regex_budget = events, zone, [], False, regex_budget
        #: Distinct values with hit null where the time ran out, one DataFrame for each guarded pattern.
        self.guarded: list[DataFrame] = []

    def filter(self, e: ast.Expr) -> Column:
        """A condition for where(): positive leaves of the top conjunction stay bare, since null and false filter alike and a bare comparison reaches the scan."""
        if isinstance(e, ast.And):
            out = self.filter(e.items[0])
            for x in e.items[1:]:
                out = out & self.filter(x)
            return out
        self.bare = isinstance(e, ast.Between | ast.Cond) and getattr(e, "op", "=") not in ("!=", "not contains") or isinstance(e, ast.In) and not e.negated
        try:
            return self.expr(e)
        finally:
            self.bare = False

    def two(self, c: Column) -> Column:
        return c if self.bare else F.coalesce(c, F.lit(False))

    def base(self) -> DataFrame:
        """The events with a flag column for each joined condition."""
        out = self.events.df
        for name, ids in self.flags:
            out = out.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
        return out

    def joined(self, ids: DataFrame) -> Column:
        name = f"_flag{len(self.flags)}"
        self.flags.append((name, ids))
        return F.coalesce(F.col(name), F.lit(False))

    def expr(self, e: ast.Expr) -> Column:
        match e:
            case ast.Const(v):
                return F.lit(v)
            case ast.And(items):
                out = self.expr(items[0])
                for x in items[1:]:
                    out = out & self.expr(x)
                return out
            case ast.Or(items):
                out = self.expr(items[0])
                for x in items[1:]:
                    out = out | self.expr(x)
                return out
            case ast.Not(x):
                return ~self.expr(x)
            case ast.Text(v):
                return self.text(v)
            case ast.Cond(f, op, v):
                return self.cond(f, op, v)
            case ast.FieldCond(f, op, o):
                return self.field_cond(f, op, o)
            case ast.In(f, vs, no):
                out = self.one_of(f, vs)
                return ~out if no else out
            case ast.Between(f, a, b):
                return self.between(f, a, b)
            case ast.Exists(f, no):
                out = self.exists(f)
                return ~out if no else out
        raise TypeError(e)

    # leaves

    def text(self, value: str) -> Column:
        if not value:
            return F.lit(False)
        out = None
        for _, key in sorted(self.events.keys.items()):
            hit = key.any(lambda v: F.contains(F.lower(v), F.lower(F.lit(value))))
            out = hit if out is None else out | hit
        return F.lit(False) if out is None else out

    def cond(self, name: str, op: str, value: str) -> Column:
        target = resolve(self.events, name)
        if target == "time":
            return self.time(op, value)
        if isinstance(target, str):
            return self.special(name, target, op, value)
        if op == "=":
            return self.equals(target, value)
        if op == "==":
            if X.has_mask(value):
                return target.any(mask_test(value))
            if target.many:
                return self.two(F.array_contains(target.text, value))
            own = self.native(target, value) if target.native is not None else None
            return own if own is not None else target.any(lambda v: v == value)
        if op == "!=":
            return ~self.equals(target, value)
        if op in ("<", "<=", ">", ">="):
            return self.order(target, op, value)
        if op == "contains":
            return self.substring(target, value, F.contains)
        if op == "not contains":
            return ~self.substring(target, value, F.contains)
        if op == "startswith":
            return self.substring(target, value, F.startswith)
        if op == "endswith":
            return self.substring(target, value, F.endswith)
        if op == "like":
            return target.any(lambda v: X.matches_mask(v, value)) if value else F.lit(False)
        if op == "matches":
            if not valid(value):
                raise QueryError("bad-regex", f"{value!r} is not a regular expression")
            if self.regex_budget is not None:
                return self.in_time(target, value)
            return target.any(lambda v: matches(v, value))
        if op == "cidr":
            return target.any(lambda v: net.in_subnet(v, value))
        raise QueryError("operator-expected", f"unknown operator {op}")

    def in_time(self, key: Key, pattern: str) -> Column:
        """Matching with a time limit, on distinct values."""
        own = self.events.df.select("id", F.explode(key.text if key.many else F.array(key.text)).alias("v"))
        found = guarded(own, F.col("v"), pattern, self.regex_budget)
        self.guarded.append(found)
        return self.joined(own.join(found.where("hit").select(F.col("value").alias("v")), "v", "left_semi"))

    def native(self, key: Key, value: str) -> Column | None:
        """A bare comparison of a native column, which the scan can use, for a literal in the column's canonical text."""
        if key.native is None:
            return None
        column = F.col(f"`{key.native}`")
        if key.number is None:
            return self.two(column == value)
        kind = self.events.df.schema[key.native].dataType.typeName()
        n = X.number_of(value)
        if kind in ("integer", "long", "short", "byte") and n is not None and str(n) == value:
            return self.two(column == F.lit(n))
        return None

    def equals(self, key: Key, value: str) -> Column:
        values = LEVELS.get(value.lower(), (value,)) if key.name == "@Level" else (value,)
        out = None
        for v in values:
            one = self.native(key, v) if key.number is not None else None
            one = one if one is not None else key.any(mask_test(v))
            out = one if out is None else out | one
        return out

    def order(self, key: Key, op: str, value: str) -> Column:
        if key.number is not None and not key.many:
            try:
                n = X.number_of(value)
                n = float(value) if n is None else n
            except ValueError:
                raise QueryError("number-needed", f"{op} needs a number, not {value!r}") from None
            return self.two(_compare(key.number, op, n))
        n = X.number_of(value)
        if n is None:
            raise QueryError("number-needed", f"{op} needs a whole number, not {value!r}")
        return key.any(lambda v: _compare(X.number(v), op, n))

    def substring(self, key: Key, value: str, test) -> Column:
        if not value:
            return F.lit(False)
        return key.any(lambda v: test(F.lower(v), F.lower(F.lit(value))))

    def one_of(self, name: str, values: tuple[str, ...]) -> Column:
        target = resolve(self.events, name)
        if target == "time":
            raise QueryError("field-use", "time cannot be used with in")
        if isinstance(target, str):
            out = None
            for v in values:
                one = self.special(name, target, "=", v)
                out = one if out is None else out | one
            return out
        plain, out = [], None
        for v in values:
            if X.has_mask(v) or target.name == "@Level":
                one = self.equals(target, v)
                out = one if out is None else out | one
            else:
                plain.append(v)
        if plain:
            one = self.listed(target, plain)
            out = one if out is None else out | one
        return out

    def listed(self, key: Key, values: list[str]) -> Column:
        if len(values) > LONG_LIST:  # a semi join instead of a long expression
            spark = self.events.df.sparkSession
            wanted = spark.createDataFrame([(v,) for v in values], "v string").select(F.lower("v").alias("v")).distinct()
            own = self.events.df.select("id", F.explode(key.text if key.many else F.array(key.text)).alias("v")).select("id", F.lower("v").alias("v"))
            return self.joined(own.join(F.broadcast(wanted), "v", "left_semi"))  # at most 10,000 values
        if key.number is not None and all(str(X.number_of(v)) == v for v in values) and self.native(key, values[0]) is not None:
            return self.two(F.col(f"`{key.native}`").isin([int(v) for v in values]))
        lowered = [F.lower(F.lit(v)) for v in values]
        if key.many:
            return F.coalesce(F.arrays_overlap(F.transform(F.filter(key.text, lambda v: v.isNotNull()), lambda v: F.lower(v)), F.array(*lowered)), F.lit(False))
        return F.coalesce(F.lower(key.text).isin(*lowered), F.lit(False))

    def between(self, name: str, a: str, b: str) -> Column:
        target = resolve(self.events, name)
        if target == "time":
            lo, hi = sorted((self.instant(a), self.instant(b)))
            return self.two(self.events.time.between(lo, hi))
        if isinstance(target, str):
            raise QueryError("field-use", f"{name} cannot be used with between")
        lo, hi = X.number_of(a), X.number_of(b)
        if target.number is not None and not target.many:
            try:
                lo, hi = (float(x) if n is None else n for x, n in ((a, lo), (b, hi)))
            except ValueError:
                raise QueryError("number-needed", "between needs two numbers") from None
            return self.two(target.number.between(min(lo, hi), max(lo, hi)))
        if lo is None or hi is None:
            raise QueryError("number-needed", "between needs two whole numbers or times")
        return target.any(lambda v: X.number(v).between(min(lo, hi), max(lo, hi)))

    def exists(self, name: str) -> Column:
        target = resolve(self.events, name)
        if target == "tag":
            return self.tagged("*")
        if target == "rule":
            return self.joined(self.detections("rule")[1])
        if isinstance(target, str):
            raise QueryError("field-use", f"{name} cannot be used with exists")
        return target.present

    def field_cond(self, name: str, op: str, other: str) -> Column:
        a, b = key_of(self.events, name, "a comparison of fields"), key_of(self.events, other, "a comparison of fields")
        if a.name.startswith("@") or b.name.startswith("@"):
            return F.lit(op == "!=")  # system keys are no event data
        x, y = F.lower(a.first), F.lower(b.first)
        if op in ("=", "!="):
            out = F.coalesce(x == y, F.lit(False))
            return ~out if op == "!=" else out
        if op == "==":
            return F.coalesce(a.first == b.first, F.lit(False))
        test = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op]
        return F.coalesce((y != "") & test(x, y), F.lit(False))

    # time

    def instant(self, text: str) -> int:
        t = parse_time(text, self.zone)
        if t is None:
            raise QueryError("bad-time", f"{text!r} is not a time")
        return t

    def time(self, op: str, value: str) -> Column:
        ft = self.events.time
        t = self.instant(value)
        if op in ("<", "<=", ">", ">="):
            return self.two(_compare(ft, op, t))
        inside = F.coalesce((ft >= t) & (ft < t + SECOND), F.lit(False))
        if op in ("=", "=="):
            return inside
        if op == "!=":
            return ~inside
        raise QueryError("field-use", f"time cannot be used with {op}")

    # entities, tags, detections

    def special(self, name: str, target: str, op: str, value: str) -> Column:
        if target in ("host", "user", "ip"):
            if op not in ("=", "==", "!="):
                raise QueryError("field-use", f"{name} takes =, != and in")
            if self.events.entities is None:
                raise QueryError("no-entities", "the entity registry is not built")
            found = self.events.entities.where((F.col("kind") == target) & F.array_contains("names", F.lower(F.lit(value))))
            out = self.joined(found)
            return ~out if op == "!=" else out
        if target == "tag":
            if op not in ("=", "==", "!="):
                raise QueryError("field-use", f"{name} takes =, !=, in and exists")
            out = self.tagged(value)
            return ~out if op == "!=" else out
        rules, hits = self.detections(target)
        if target == "rule":
            if op in ("=", "==", "!="):
                own = mask_test(value)(F.col("title")) | (F.lower("rule_id") == value.lower())
                if X.number_of(value) is not None:
                    own = own | (F.col("rule") == X.number_of(value))
            elif op == "contains":
                own = F.contains(F.lower("title"), F.lower(F.lit(value))) if value else F.lit(False)
            else:
                raise QueryError("field-use", f"{name} takes =, !=, in, contains and exists")
        else:
            rank = RANK.get(value.lower())
            if rank is None:
                raise QueryError("bad-level", f"{value!r} is not a rule level")
            if op not in ("=", "==", "!=", "<", "<=", ">", ">="):
                raise QueryError("field-use", f"{name} takes =, !=, in and comparisons")
            own = _compare(level_rank(F.col("level")), "==" if op in ("=", "==", "!=") else op, rank)
        ids = hits.join(rules.where(F.coalesce(own, F.lit(False))).select("rule"), "rule", "left_semi")
        out = self.joined(ids)
        return ~out if op == "!=" else out

    def tagged(self, value: str) -> Column:
        marks = self.events.annotations
        if marks is None:
            return F.lit(False)
        return self.joined(marks if value == "*" else marks.where(F.lower("colour") == value.lower()))

    def detections(self, name: str) -> tuple[DataFrame, DataFrame]:
        if self.events.rules is None or self.events.hits is None:
            raise QueryError("no-detections", f"{name} needs a detection run")
        return self.events.rules, self.events.hits


def level_rank(level: Column) -> Column:
    pairs = [x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(level)]


def _compare(c: Column, op: str, n) -> Column:
    return {"<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n, "==": c == n}[op]
