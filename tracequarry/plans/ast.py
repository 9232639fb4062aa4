"""Syntax tree of a query. All nodes are immutable and compare by value."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Operators between a field and a value, in their canonical spelling, and other spellings.
SYMBOLS = ("==", "!=", "<=", ">=", "!~", "=", "<", ">", "~")
WORDS = ("contains", "startswith", "endswith", "like", "matches", "regex", "cidr")
CANONICAL = {"~": "contains", "!~": "not contains", "regex": "matches"}
#: Operators that may stand between two fields.
FIELD_OPS = ("=", "==", "!=", "contains", "startswith", "endswith")
STAGES = ("where", "search", "select", "project", "group", "sort", "order", "limit", "take")
KEYWORDS = frozenset(("and", "or", "not", "in", "between", "exists", "true", "false", *WORDS, *STAGES))


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Const(Expr):
    value: bool


@dataclass(frozen=True)
class And(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    item: Expr


@dataclass(frozen=True)
class Text(Expr):
    """The text occurs in any value of the event."""

    value: str


@dataclass(frozen=True)
class Cond(Expr):
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class FieldCond(Expr):
    field: str
    op: str
    other: str


@dataclass(frozen=True)
class In(Expr):
    field: str
    values: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Exists(Expr):
    field: str
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """A pipeline flattened: the filter joins all where and search stages; of the others the last one counts."""

    filter: Expr | None = None
    select: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = field(default=())  # (field, descending)
    limit: int | None = None
