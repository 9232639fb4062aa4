"""The one error type of the query language: what kind of mistake, and where."""

from __future__ import annotations


class QueryError(ValueError):
    """kind is a stable word for programs; at is the character position in the query, where known."""

    def __init__(self, kind: str, message: str, at: int | None = None) -> None:
        super().__init__(message if at is None else f"{message} (at character {at + 1})")
        self.kind, self.at = kind, at
