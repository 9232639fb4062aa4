"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .ast import SYMBOLS
from .errors import QueryError

MOST_TOKENS = 200_000
_WORD = re.compile(r"""[^\s(),|"'`=!<>~]+""")
_SYMBOL = re.compile("|".join(map(re.escape, SYMBOLS)))


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, field, op, mark, end
    text: str
    at: int

    def word(self, *options: str) -> bool:
        return self.kind == "word" and self.text.lower() in options


def _quoted(text: str, at: int) -> tuple[str, int]:
    """A quoted string from its opening quote on; only the quote itself and the backslash can be escaped."""
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in (quote, "\\"):
            out.append(text[i + 1])
            i += 2
        elif c == quote:
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise QueryError("unclosed-quote", "a quote is not closed", at)


def tokens(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if len(out) >= MOST_TOKENS - 1:
            raise QueryError("too-long", "the query is too long", i)
        if c in "(),|":
            out.append(Token("mark", c, i))
            i += 1
        elif c in "\"'":
            value, end = _quoted(text, i)
            out.append(Token("string", value, i))
            i = end
        elif c == "`":
            end = text.find("`", i + 1)
            if end < 0:
                raise QueryError("unclosed-quote", "a field quote is not closed", i)
            out.append(Token("field", text[i + 1 : end], i))
            i = end + 1
        elif m := _SYMBOL.match(text, i):
            out.append(Token("op", m[0], i))
            i = m.end()
        elif m := _WORD.match(text, i):
            out.append(Token("word", m[0], i))
            i = m.end()
        else:
            raise QueryError("unknown-operator", f"no operator starts with {c!r}", i)
    out.append(Token("end", "", len(text)))
    return out
