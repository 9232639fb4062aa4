"""Run queries: filter, then groups or sorted events, lazily as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key, number
from ..model import EventSet
from ..plans import ast, printer
from ..plans.compile import Compiler, key_of, resolve
from ..plans.errors import QueryError
from ..plans.parser import parse

MISSING = "—"
#: Groups that a grouping keeps, as a list to look at does; a caller that wants them all says so.
MOST_GROUPS = 20_000


@dataclass(frozen=True)
class Result:
    """filtered: all events that pass (histograms use it). Either groups, or events in order and limit."""

    query: ast.Query
    source: EventSet
    filtered: DataFrame
    events: DataFrame | None = None
    groups: DataFrame | None = None
    group_total: DataFrame | None = None
    most_groups: int | None = MOST_GROUPS
    guarded: tuple[DataFrame, ...] = ()

    def out_of_time(self) -> int:
        """Distinct values that regular expressions under a time limit gave up on."""
        return sum(g.where("hit is null").count() for g in self.guarded)

    def rows(self) -> DataFrame:
        """Groups, or events with time and the selected fields (all fields without a selection)."""
        if self.groups is not None:
            return self.groups
        if self.query.select:
            return self.events.select("id", F.col("ts_ft"), *selected(self.source, self.query.select))
        return self.events

    def truncated(self) -> bool:
        return self.group_total is not None and self.most_groups is not None and self.group_total.first()[0] > self.most_groups


def selected(events: EventSet, names: tuple[str, ...]) -> list[Column]:
    out = []
    for name in names:
        target = resolve(events, name)
        if target == "time":
            continue  # always there
        if isinstance(target, str):
            raise QueryError("field-use", f"{name} cannot be selected")
        out.append(target.first.alias(name))
    return out


def run(events: EventSet, query: str | ast.Query, zone: str = "UTC", regex_budget: float | None = None, most_groups: int | None = MOST_GROUPS) -> Result:
    """A query over events. Stages keep no order: all conditions filter first, then groups or sort, then limit. None for most_groups keeps all groups."""
    q = parse(query) if isinstance(query, str) else query
    compiler = Compiler(events, zone, regex_budget)
    condition = F.lit(True) if q.filter is None else compiler.filter(q.filter)
    filtered = compiler.base().where(condition).drop(*[name for name, _ in compiler.flags])
    selected(events, q.select)  # unknown fields are errors even where they are not shown
    if q.group:
        groups, total = grouped(events, filtered, q, most_groups)
        return Result(q, events, filtered, groups=groups, group_total=total, most_groups=most_groups, guarded=tuple(compiler.guarded))
    return Result(q, events, filtered, events=ordered(events, filtered, q), guarded=tuple(compiler.guarded))


def grouped(events: EventSet, filtered: DataFrame, q: ast.Query, most: int | None = MOST_GROUPS) -> tuple[DataFrame, DataFrame]:
    keys = [F.coalesce(key_of(events, n, "group by").first, F.lit(MISSING)).alias(n) for n in q.group]
    counts = filtered.groupBy(*keys).agg(F.count("*").alias("count"))
    names = [F.col(f"`{n}`") for n in q.group]
    by = [F.desc("count"), *names]
    if q.sort:
        field, desc = q.sort[0]
        if field.lower() == "count" and field not in q.group:
            by = [F.desc("count") if desc else F.asc("count"), *names]
        elif field in q.group:
            own = natural_key(F.col(f"`{field}`"))
            by = [own.desc() if desc else own.asc(), *names]
    capped = counts if most is None else counts.orderBy(F.desc("count"), *names).limit(most)
    limit = most if q.limit is None else q.limit
    shown = capped.orderBy(*by)
    return shown if limit is None else shown.limit(limit), counts.agg(F.count("*").alias("n"))


def ordered(events: EventSet, filtered: DataFrame, q: ast.Query) -> DataFrame:
    """Events in order; with a limit Spark keeps only the first rows of each task."""
    if not q.sort:
        out = filtered.orderBy("id")
        return out if q.limit is None else out.limit(q.limit)
    field, desc = q.sort[0]
    target = resolve(events, field)
    if target == "time":
        if q.limit is None:
            return filtered.orderBy(F.desc("id") if desc else F.asc("id"))
        return filtered.orderBy(F.desc("id") if desc else F.asc("id")).limit(q.limit)
    if isinstance(target, str):
        raise QueryError("field-use", f"{field} cannot be sorted by")
    n = target.number if target.number is not None and not target.many else number(target.first)
    text = natural_key(target.first)
    # numbers by value, then other text in natural order, events without the field last; time breaks ties
    by = [F.when(n.isNotNull(), 0).when(target.first.isNotNull(), 1).otherwise(2)]
    flip = (lambda c: c.desc_nulls_last()) if desc else (lambda c: c.asc_nulls_last())
    if desc:
        by = [F.when(target.first.isNull(), 2).when(n.isNotNull(), 1).otherwise(0)]
    out = filtered.orderBy(*by, flip(n), flip(text), "id")
    return out if q.limit is None else out.limit(q.limit)


# groups back to events


def drill_down(events: EventSet, result: Result, values: dict[str, str]) -> DataFrame:
    """Events of a group: any value of each key equals exactly; the mark for missing means the field is absent."""
    out = result.filtered
    for name, value in values.items():
        key = key_of(events, name, "a group")
        out = out.where(~key.present if value == MISSING else key.any(equal_to(value)))
    return out


def equal_to(value: str):
    return lambda v: v == value


def drill_text(query: str | ast.Query, values: dict[str, str]) -> str:
    """The query without its grouping, with a condition for each value of the group that is not missing."""
    q = parse(query) if isinstance(query, str) else query
    extra = tuple(ast.Cond(n, "=", v) for n, v in values.items() if v != MISSING)
    items = ((q.filter,) if q.filter is not None else ()) + extra
    whole = None if not items else items[0] if len(items) == 1 else ast.And(items)
    return printer.query(ast.Query(whole, q.select, (), (), None))


def cancel(spark, tag: str) -> None:
    """Stop the jobs of a query that ran under a tag (spark.addTag)."""
    spark.interruptTag(tag)
