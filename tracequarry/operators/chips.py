"""Filter chips: values of keys, joined by or within a key and by and across keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EventSet
from ..plans.compile import Compiler, resolve
from ..plans.errors import QueryError


@dataclass(frozen=True)
class Chip:
    key: str
    value: str
    negated: bool = False
    enabled: bool = True


def matching(compiler: Compiler, key: str, value: str, exact: bool = False) -> Column:
    """Equality with a value; an unknown key matches nothing."""
    try:
        target = resolve(compiler.events, key)
    except QueryError:
        return F.lit(False)
    if isinstance(target, str):
        return compiler.cond(key, "=", value)
    return target.any((lambda v: v == value) if exact else (lambda v: F.lower(v) == F.lower(F.lit(value))))


def with_field(events: EventSet, key: str) -> DataFrame:
    return events.df.where(events.keys[key].present) if key in events.keys else events.df.where(F.lit(False))


def evaluate(events: EventSet, chips: list[Chip], start: int | None = None, end: int | None = None) -> DataFrame:
    """Events that pass the chips within an inclusive time range in ticks."""
    compiler = Compiler(events)
    wanted: dict[str, Column] = {}
    out = F.lit(True)
    for chip in (c for c in chips if c.enabled):
        hit = matching(compiler, chip.key, chip.value)
        if chip.negated:
            out = out & ~hit
        else:
            wanted[chip.key] = wanted[chip.key] | hit if chip.key in wanted else hit
    for hit in wanted.values():
        out = out & hit
    if start is not None:
        out = out & (events.time >= start)
    if end is not None:
        out = out & (events.time <= end)
    return compiler.base().where(out).drop(*[n for n, _ in compiler.flags])


def log_view(levels: list[str], keywords: list[str], query: str = "") -> str:
    """The query of the log viewer: level and audit chips joined with the user's own filter, newest first."""
    from ..plans import printer

    parts = [f"level in ({', '.join(map(printer.value, levels))})"] if levels else []
    parts += [f"keywords in ({', '.join(map(printer.value, keywords))})"] if keywords else []
    parts += [f"({query})"] if query.strip() else []
    return " and ".join(parts) + (" | " if parts else "") + "sort by time desc"
