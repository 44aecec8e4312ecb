"""Errors of the query language."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all errors that a query can cause."""


class SyntaxProblem(GraphError):
    """Text that isn't a program. Rendered with line, column, the line and a caret."""

    def __init__(self, message: str, source: str, at: int):
        self.message, self.source, self.at = message, source, at
        super().__init__(self.render())

    @property
    def line(self) -> int:
        return self.source.count("\n", 0, self.at) + 1

    @property
    def column(self) -> int:
        return self.at - (self.source.rfind("\n", 0, self.at) + 1) + 1

    def render(self) -> str:
        text = self.source.split("\n")[self.line - 1]
        return f"{self.line}:{self.column}: error: {self.message}\n{text}\n{' ' * (self.column - 1)}^"


class Unsupported(GraphError):
    """Valid syntax without a meaning here."""


class UnknownIdentifier(GraphError):
    """A name that no clause binds."""


class WrongType(GraphError):
    """A value or variable of a kind that the operation can't take."""


class MissingParameter(GraphError):
    """A parameter without a value."""


class WrongResultKind(GraphError):
    """Rows asked of a mutation, or a count of a row query."""


class Busy(GraphError):
    """Another transaction changed the same elements first."""
