"""Query text from a syntax tree; parsing it again gives the same tree."""

from __future__ import annotations

import re

from . import ast
from .errors import QueryError

_PLAIN = re.compile(r"""[^\s(),|"'`=!<>~]+\Z""")


def name(field: str) -> str:
    if "`" in field:
        raise QueryError("field-name", "a field name with a backtick cannot be written")
    return field if _PLAIN.match(field) and field.lower() not in ast.KEYWORDS | {"by", "asc", "desc"} else f"`{field}`"


def value(text: str) -> str:
    if _PLAIN.match(text):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def expression(e: ast.Expr, inside: str = "") -> str:
    """inside: the connective around, which decides on parentheses."""
    match e:
        case ast.Const(v):
            return "true" if v else "false"
        case ast.Text(v):
            return quoted(v)
        case ast.Cond(f, op, v):
            return f"{name(f)} {op} {value(v)}"
        case ast.FieldCond(f, op, o):
            name(o)
            return f"{name(f)} {op} `{o}`"
        case ast.In(f, vs, no):
            return f"{name(f)} {'not ' * no}in ({', '.join(map(value, vs))})"
        case ast.Between(f, a, b):
            return f"{name(f)} between {value(a)} and {value(b)}"
        case ast.Exists(f, no):
            return f"{name(f)} {'not ' * no}exists"
        case ast.Not(x):
            return f"not {expression(x, 'not')}"
        case ast.And(items):
            out = " and ".join(expression(x, "and") for x in items)
        case ast.Or(items):
            out = " or ".join(expression(x, "or") for x in items)
        case _:
            raise TypeError(e)
    return f"({out})" if inside else out


def query(q: ast.Query) -> str:
    parts = [] if q.filter is None else [expression(q.filter)]
    if q.select:
        parts.append("select " + ", ".join(map(name, q.select)))
    if q.group:
        parts.append("group by " + ", ".join(map(name, q.group)))
    if q.sort:
        parts.append("sort by " + ", ".join(name(f) + " desc" * d for f, d in q.sort))
    if q.limit is not None:
        parts.append(f"limit {q.limit}")
    return " | ".join(parts)
