"""Expressions whose form depends on where they stand.

``mean("x")`` is an aggregate in a summary, but a window over the group when it stands beside row
values. A ``Deferred`` is built when the verb that uses it says which it is.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NonScalarValueError
from ..names import c, check_known, fresh
from ..order import OrderBy, Ranges, window, with_index


class Context:
    """Where an expression stands: a summary of groups, or the rows of a (grouped) frame.

    Without keys, aggregates beside row values come from a one-row frame that is joined on, and
    positional functions work range by range; both are steps on the frame before the expression.
    """

    def __init__(self, df: DataFrame, by: tuple[str, ...] = (), order_by: OrderBy = None, *, summary: bool = False):
        self.df, self.by, self.order_by, self.summary = df, tuple(by), order_by, summary
        self.aggregates: dict[str, Column] = {}
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self.made: list[str] = []

    def __getitem__(self, name: str) -> Column:
        check_known(self.df, [name])
        return c(name)

    def _name(self) -> str:
        name = fresh(self.df, f"__made{len(self.made)}")
        self.made.append(name)
        return name

    def agg(self, value: Column) -> Column:
        """An aggregate, in the form that fits here."""
        if self.summary:
            return value
        if self.by:
            return value.over(Window.partitionBy(*[c(k) for k in self.by]))
        name = self._name()
        self.aggregates[name] = value
        return F.col(name)

    def over(self, value: Column, *, frame: tuple[int, int] | None = None, back: bool = False) -> Column:
        """A positional function over the group in order, or from its end; there must be keys."""
        w = window(self.df, self.by, self.order_by, back=back)
        return value.over(w.rowsBetween(*frame) if frame else w)

    def positional(self, grouped: Callable[[Context], Column], whole: Callable[[DataFrame, str], DataFrame]) -> Column:
        """``grouped`` makes the column within groups, ``whole`` adds it to an ungrouped frame."""
        if self.summary:
            raise NonScalarValueError("a summary must be one value for each group")
        if self.by:
            return grouped(self)
        name = self._name()
        self.steps.append(lambda df: whole(df, name))
        return F.col(name)

    def apply(self, values: dict[str, Column], then: Callable[[DataFrame, dict[str, Column]], DataFrame]) -> DataFrame:
        """Run the steps that the values need, use them, and drop what the steps made."""
        df = self.df
        for step in self.steps:
            df = step(df)
        if self.aggregates:
            one = self.df.agg(*[v.alias(n) for n, v in self.aggregates.items()])
            df = df.crossJoin(F.broadcast(one))  # one row
        return then(df, values).drop(*self.made) if self.made else then(df, values)


class Deferred:
    """Builds a Column for a Context; takes part in arithmetic, comparisons and logic."""

    def __init__(self, build: Callable[[Context], Column]):
        self.build = build

    def _with(self, other: Any, op) -> Deferred:
        return Deferred(lambda x: op(self.build(x), resolve(other, x)))

    def _before(self, other: Any, op) -> Deferred:
        return Deferred(lambda x: op(resolve(other, x), self.build(x)))

    def __neg__(self) -> Deferred:
        return Deferred(lambda x: -self.build(x))

    def __invert__(self) -> Deferred:
        return Deferred(lambda x: ~self.build(x))

    def call(self, fn: Callable[[Column], Column]) -> Deferred:
        """Any function of the column, e.g. ``mean("x").call(lambda m: F.round(m, 2))``."""
        return Deferred(lambda x: fn(self.build(x)))


for _name in ("add", "sub", "mul", "truediv", "mod", "gt", "ge", "lt", "le", "eq", "ne", "and", "or"):
    _op = getattr(operator, f"__{_name}__")
    setattr(Deferred, f"__{_name}__", lambda self, other, op=_op: self._with(other, op))
for _name in ("add", "sub", "mul", "truediv", "mod", "and", "or"):
    _op = getattr(operator, f"__{_name}__")
    setattr(Deferred, f"__r{_name}__", lambda self, other, op=_op: self._before(other, op))
Deferred.__hash__ = object.__hash__


def resolve(value: Any, x: Context) -> Column:
    """A Column of a Column, Deferred, callable of the context, or constant."""
    if isinstance(value, Deferred):
        return value.build(x)
    if isinstance(value, Column):
        return value
    if callable(value):
        return resolve(value(x), x)
    return F.lit(value)


def as_column(value: str | Column, x: Context) -> Column:
    """A column by name, or an expression."""
    return x[value] if isinstance(value, str) else resolve(value, x)


def row_number() -> Deferred:
    """1 .. number of rows, within the group or the whole frame."""
    return Deferred(
        lambda x: x.positional(lambda g: g.over(F.row_number()), lambda df, name: with_index(df, x.order_by, name))
    )


__all__ = ["Context", "Deferred", "Ranges", "as_column", "resolve", "row_number"]
