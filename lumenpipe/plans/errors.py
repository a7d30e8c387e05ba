"""Errors and warnings of the query language."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all query errors."""


class ParseError(QueryError):
    """Syntax error at a byte offset of the text."""

    def __init__(self, message: str, offset: int, length: int = 1) -> None:
        super().__init__(f"{message} at offset {offset}")
        self.message, self.offset, self.length = message, offset, length


class UnknownField(QueryError):
    pass


class InvalidQuery(QueryError):
    pass


class UnsupportedStage(QueryError):
    pass


class ResourceLimit(QueryError):
    pass


class ExecutionError(QueryError):
    pass
