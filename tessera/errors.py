"""Errors of the verbs."""

from __future__ import annotations


class TesseraError(Exception):
    """Base of all errors raised here."""


class ColumnTypeCastError(TesseraError, TypeError):
    """A column doesn't have the type that was asked for."""


class MissingValueError(TesseraError, ValueError):
    """Missing values where none are allowed."""


class DuplicatedColumnNameError(TesseraError, ValueError):
    """Column names must be unique."""

    def __init__(self, names):
        self.names = sorted({n for n in names if list(names).count(n) > 1})
        super().__init__(f"duplicated column names: {', '.join(self.names)}")


class InvalidColumnOperationError(TesseraError, TypeError):
    """The operation isn't defined for the column's type."""


class NonScalarValueError(TesseraError, ValueError):
    """A summary must be one value for each group."""


class InvalidSortingPredicateError(TesseraError, ValueError):
    """A sort key must be an expression."""


class InvalidColumnSelectError(TesseraError, ValueError):
    """Positive and negative selections can't be mixed."""


class UnknownColumnError(TesseraError, KeyError):
    """No such column."""

    def __str__(self) -> str:
        return str(self.args[0])


class OrderRequiredError(TesseraError, ValueError):
    """The verb depends on row order, and none was given."""
