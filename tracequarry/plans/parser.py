"""Recursive-descent parser: not binds before and, and before or; conditions side by side are joined by and."""

from __future__ import annotations

from . import ast
from .errors import QueryError
from .lexer import Token, tokens

DEPTH, MOST_VALUES = 64, 10_000


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.i, self.depth = tokens(text), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    @property
    def after(self) -> Token:
        return self.tokens[min(self.i + 1, len(self.tokens) - 1)]

    def step(self) -> Token:
        token = self.now
        self.i += token.kind != "end"
        return token

    def mark(self, text: str) -> bool:
        if self.now.kind == "mark" and self.now.text == text:
            self.i += 1
            return True
        return False

    def takes(self, *words: str) -> bool:
        if self.now.word(*words):
            self.i += 1
            return True
        return False

    # pipeline

    def query(self) -> ast.Query:
        filters: list[ast.Expr] = []
        out: dict = {"sort": ()}
        if self.now.kind != "end" and not self.now.word(*ast.STAGES) and not (self.now.kind == "mark" and self.now.text == "|"):
            filters.append(self.expression())
        while self.now.kind != "end":
            piped = self.mark("|")
            if not self.now.word(*ast.STAGES):
                if piped and self.now.kind in ("word", "end"):
                    raise QueryError("unknown-stage", f"no stage is called {self.now.text!r}", self.now.at)
                raise QueryError("pipe-expected", "a stage or the end of the query is expected", self.now.at)
            self.stage(filters, out)
        whole = None if not filters else filters[0] if len(filters) == 1 else ast.And(tuple(filters))
        return ast.Query(whole, **out)

    def stage(self, filters: list[ast.Expr], out: dict) -> None:
        name = self.step().text.lower()
        if name == "where":
            filters.append(self.expression())
        elif name == "search":
            token = self.step()
            if token.kind != "string":
                raise QueryError("string-expected", "search takes a quoted string", token.at)
            filters.append(ast.Text(token.text))
        elif name in ("select", "project"):
            out["select"] = self.names()
        elif name == "group":
            self.takes("by")
            out["group"] = self.names()
        elif name in ("sort", "order"):
            self.takes("by")
            keys = [self.sort_key()]
            while self.mark(","):
                keys.append(self.sort_key())
            out["sort"] += tuple(keys)
        else:
            token = self.step()
            if token.kind != "word" or not (token.text.isascii() and token.text.isdigit()):
                raise QueryError("number-expected", f"{name} takes a whole number", token.at)
            out["limit"] = int(token.text)

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.mark(","):
            out.append(self.name())
        return tuple(out)

    def sort_key(self) -> tuple[str, bool]:
        field = self.name()
        if self.takes("desc"):
            return field, True
        self.takes("asc")
        return field, False

    def name(self) -> str:
        token = self.step()
        if token.kind == "field" or token.kind == "word":
            return token.text
        raise QueryError("field-expected", "a field name is expected", token.at)

    # expressions

    def expression(self) -> ast.Expr:
        self.depth += 1
        if self.depth >= DEPTH:
            raise QueryError("too-deep", f"expressions nest deeper than {DEPTH}", self.now.at)
        items = [self.conjunction()]
        while self.takes("or"):
            items.append(self.conjunction())
        self.depth -= 1
        return items[0] if len(items) == 1 else ast.Or(tuple(items))

    def conjunction(self) -> ast.Expr:
        items = [self.unary()]
        while True:
            if self.takes("and"):
                items.append(self.unary())
            elif self.starts_condition():
                items.append(self.unary())
            else:
                return items[0] if len(items) == 1 else ast.And(tuple(items))

    def starts_condition(self) -> bool:
        token = self.now
        if token.kind in ("string", "field"):
            return True
        if token.kind == "mark":
            return token.text == "("
        return token.kind == "word" and not token.word("or", *ast.STAGES)

    def unary(self) -> ast.Expr:
        nots = 0
        while self.now.word("not"):
            nots += 1
            if nots + self.depth >= DEPTH:
                raise QueryError("too-deep", f"expressions nest deeper than {DEPTH}", self.now.at)
            self.i += 1
        out = self.primary()
        for _ in range(nots):
            out = ast.Not(out)
        return out

    def primary(self) -> ast.Expr:
        token = self.now
        if self.mark("("):
            inner = self.expression()
            if not self.mark(")"):
                raise QueryError("close-expected", "a closing parenthesis is expected", self.now.at)
            return inner
        if token.kind == "string":
            self.i += 1
            return ast.Text(token.text)
        if token.word("true", "false") and not self.operator_follows():
            self.i += 1
            return ast.Const(token.text.lower() == "true")
        return self.condition()

    def operator_follows(self) -> bool:
        return self.after.kind == "op" or self.after.word(*ast.WORDS, "in", "between", "exists")

    def condition(self) -> ast.Expr:
        if self.now.kind == "word" and self.now.word(*ast.STAGES) or self.now.kind not in ("word", "field"):
            raise QueryError("field-expected", "a field name is expected", self.now.at)
        field = self.name()
        token = self.now
        if self.takes("exists"):
            return ast.Exists(field)
        if self.takes("in"):
            return ast.In(field, self.values())
        if self.takes("between"):
            low = self.value()
            if not self.takes("and"):
                raise QueryError("and-expected", "between takes two values joined by and", self.now.at)
            return ast.Between(field, low, self.value())
        if self.takes("not"):
            if self.takes("in"):
                return ast.In(field, self.values(), True)
            if self.takes("exists"):
                return ast.Exists(field, True)
            if self.takes("contains"):
                return ast.Cond(field, "not contains", self.value())
            raise QueryError("wrong-not", "after a field, not stands before in, contains or exists alone", self.now.at)
        if token.kind == "op" or token.word(*ast.WORDS):
            self.i += 1
            op = token.text.lower()
            op = ast.CANONICAL.get(op, op)
            if self.now.kind == "field":
                if op not in ast.FIELD_OPS:
                    raise QueryError("field-operator", f"{op} does not compare two fields", token.at)
                return ast.FieldCond(field, op, self.step().text)
            return ast.Cond(field, op, self.value())
        raise QueryError("operator-expected", f"an operator is expected after {field!r}", token.at)

    def value(self) -> str:
        token = self.step()
        if token.kind in ("word", "string"):
            return token.text
        raise QueryError("value-expected", "a value is expected", token.at)

    def values(self) -> tuple[str, ...]:
        at = self.now.at
        if not self.mark("("):
            raise QueryError("list-expected", "a list in parentheses is expected", at)
        out = [self.value()]
        while self.mark(","):
            out.append(self.value())
            if len(out) > MOST_VALUES:
                raise QueryError("list-too-long", f"a list holds {MOST_VALUES} values at most", at)
        if not self.mark(")"):
            raise QueryError("close-expected", "a closing parenthesis is expected", self.now.at)
        return tuple(out)


def parse(text: str) -> ast.Query:
    return _Parser(text).query()


def parse_filter(text: str) -> ast.Expr:
    parser = _Parser(text)
    out = parser.expression()
    if parser.now.kind != "end":
        raise QueryError("pipe-expected", "the end of the filter is expected", parser.now.at)
    return out
