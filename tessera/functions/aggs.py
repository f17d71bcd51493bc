"""Column aggregates. Beside row values they are broadcast to the group.

With ``remove_na=False`` (the default) missing values raise an error when the plan runs. An empty
column gives null, but a sum of 0. ``sd`` is the population's, and null for a single value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..errors import InvalidColumnOperationError
from .deferred import Context, Deferred, as_column

Value = "str | Column"


def _guarded(x: Context, col: Column, remove_na: bool, value: Column) -> Column:
    if remove_na:
        return value
    missing = x.agg(F.count_if(col.isNull()))
    return F.when(missing > 0, F.raise_error(F.lit("MissingValueError: the column has missing values"))).otherwise(value)


def _numeric(x: Context, value, *, boolean: bool = False) -> Column:
    col = as_column(value, x)
    if isinstance(value, str):
        kind = x.df.schema[value].dataType
        if not isinstance(kind, (NumericType, BooleanType) if boolean else NumericType):
            raise InvalidColumnOperationError(f"column {value} is not numeric")
        if isinstance(kind, BooleanType):
            return col.cast("int")
    return col


def _aggregate(fn: Callable[[Column], Column]) -> Callable[..., Deferred]:
    def make(value: str | Column, remove_na: bool = False) -> Deferred:
        def build(x: Context) -> Column:
            col = _numeric(x, value)
            return _guarded(x, col, remove_na, x.agg(fn(col)))

        return Deferred(build)

    return make


minimum = _aggregate(lambda v: F.min(v.cast("double")))
maximum = _aggregate(lambda v: F.max(v.cast("double")))
mean = _aggregate(lambda v: F.avg(v))
median = _aggregate(lambda v: F.median(v))


def sd(value: str | Column, remove_na: bool = False) -> Deferred:
    def build(x: Context) -> Column:
        col = _numeric(x, value)
        some = F.when(x.agg(F.count(col)) > 1, x.agg(F.stddev_pop(col.cast("double"))))
        return _guarded(x, col, remove_na, some)

    return Deferred(build)


def total(value: str | Column, remove_na: bool = False) -> Deferred:
    """Sum; of booleans, how many are true."""

    def build(x: Context) -> Column:
        col = _numeric(x, value, boolean=True)
        return _guarded(x, col, remove_na, F.coalesce(x.agg(F.sum(col)), F.lit(0)))

    return Deferred(build)


def n() -> Deferred:
    """Number of rows."""
    return Deferred(lambda x: x.agg(F.count("*")))


def length(value: str | Column) -> Deferred:
    """Length of a column, missing values included."""
    return Deferred(lambda x: (as_column(value, x), x.agg(F.count("*")))[1])


def n_na(value: str | Column) -> Deferred:
    return Deferred(lambda x: x.agg(F.count_if(as_column(value, x).isNull())))


def has_nulls(value: str | Column) -> Deferred:
    return Deferred(lambda x: x.agg(F.coalesce(F.bool_or(as_column(value, x).isNull()), F.lit(False))))


def first(value: str | Column, order_by: str | Column) -> Deferred:
    """The value of the first row of the group in the given order."""
    return Deferred(lambda x: x.agg(F.min_by(as_column(value, x), as_column(order_by, x))))


def last(value: str | Column, order_by: str | Column) -> Deferred:
    return Deferred(lambda x: x.agg(F.max_by(as_column(value, x), as_column(order_by, x))))


def count_where(predicate: Column) -> Deferred:
    """Rows for which the predicate holds."""
    return Deferred(lambda x: x.agg(F.count_if(predicate)))


def aggregate(expression: Column) -> Deferred:
    """Any Spark aggregate, grouped-aggregate UDFs included."""
    return Deferred(lambda x: x.agg(expression))


class SumFuns:
    """Functions for ``summarize_at``: name and maker."""

    mean = ("mean", lambda v: mean(v, remove_na=True))
    median = ("median", lambda v: median(v, remove_na=True))
    sd = ("sd", lambda v: sd(v, remove_na=True))
    n = ("n", length)
    na = ("na", n_na)


# over plain Python numbers


def list_mean(values) -> float:
    values = list(values)
    return sum(values) / len(values) if values else float("nan")


def list_median(values) -> float:
    values = sorted(values)
    k = len(values)
    return float("nan") if not k else (values[(k - 1) // 2] + values[k // 2]) / 2


def list_sd(values) -> float | None:
    values = list(values)
    if len(values) == 1:
        return None
    m = list_mean(values)
    return (sum((v - m) ** 2 for v in values) / len(values)) ** 0.5 if values else float("nan")
