"""Errors of the engine."""

from __future__ import annotations


class KqlError(Exception):
    """Any error of a query."""


class KqlCompileError(KqlError):
    """A query that can't be compiled; line and col (from 1) tell where, if that is known."""

    def __init__(self, message: str, line: int | None = None, col: int | None = None) -> None:
        super().__init__(f"{message} (line {line}, column {col})" if line else message)
        self.line, self.col = line, col


class KqlUnsupportedError(KqlCompileError):
    """A known construct that the engine doesn't offer."""


class KqlEvalError(KqlError):
    """An error while rows are computed."""
