"""Scalar expressions with explicit rules for missing values."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..names import c

Value = "str | Column"


def _col(v: str | Column) -> Column:
    return c(v) if isinstance(v, str) else v


def _or_lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def const(value) -> Column:
    """A constant column."""
    return F.lit(value)


def where(condition: Column, if_true, if_false) -> Column:
    """Vectorised choice; where the condition is missing the second."""
    return F.when(condition, _or_lit(if_true)).otherwise(_or_lit(if_false))


# ------------------------------------------------------------ predicates


def is_na(v: str | Column) -> Column:
    return _col(v).isNull()


def is_not_na(v: str | Column) -> Column:
    return _col(v).isNotNull()


def in_list(v: str | Column, values: Iterable) -> Column:
    return na_as_false(_col(v).isin(list(values)))


def na_as_false(p: Column) -> Column:
    """Missing is no. Written as a conjunction, whose first part still reaches the scan of a filter."""
    return p & p.isNotNull()


def na_as_true(p: Column) -> Column:
    return F.coalesce(p, F.lit(True))


def _compared(v, other, op: str, na_as_lowest: bool) -> Column:
    a, b = _col(v), _or_lit(other)
    plain = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
    if not na_as_lowest:
        return na_as_false(plain)
    # a missing value counts as smaller than any other, and as equal to a missing one
    both, left, right = a.isNull() & b.isNull(), a.isNull(), b.isNull()
    return (
        F.when(both, F.lit(op in ("ge", "le")))
        .when(left, F.lit(op in ("lt", "le")))
        .when(right, F.lit(op in ("gt", "ge")))
        .otherwise(plain)
    )


def gt(v, other, na_as_lowest: bool = False) -> Column:
    return _compared(v, other, "gt", na_as_lowest)


def ge(v, other, na_as_lowest: bool = False) -> Column:
    return _compared(v, other, "ge", na_as_lowest)


def lt(v, other, na_as_lowest: bool = False) -> Column:
    return _compared(v, other, "lt", na_as_lowest)


def le(v, other, na_as_lowest: bool = False) -> Column:
    return _compared(v, other, "le", na_as_lowest)


def eq(v, other) -> Column:
    return na_as_false(_col(v) == _or_lit(other))


def and_(*ps: Column) -> Column:
    out = na_as_false(ps[0])
    for p in ps[1:]:
        out = out & na_as_false(p)
    return out


def or_(*ps: Column) -> Column:
    out = na_as_false(ps[0])
    for p in ps[1:]:
        out = out | na_as_false(p)
    return out


def xor(a: Column, b: Column) -> Column:
    return na_as_false(a) != na_as_false(b)


def not_(p: Column) -> Column:
    """Negation; missing stays missing."""
    return ~p


def is_matching(v: str | Column, test: Callable[[Column], Column], missing_as: bool = False) -> Column:
    """A predicate built from Column methods (startswith, contains, rlike, ...) with a value for missing."""
    return F.coalesce(test(_col(v)), F.lit(missing_as))


# ------------------------------------------------------------ arithmetic


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division: x/0 is an infinity, 0/0 is not a number, missing stays missing."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def round_scaled(v: str | Column, digits: int) -> Column:
    """Rounds doubles as SQL engines do that scale them: times a power of ten, to the nearest whole number
    (halves away from zero), and back. Spark's own ``round`` rounds the shortest decimal text, which differs
    where a product is, or just isn't, a half. Minus zero keeps its sign."""
    x, scale = _col(v), F.lit(float(10**digits))
    scaled = x * scale
    near = F.rint(scaled)
    near = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    back = near / scale
    return F.when(F.abs(back) < float("inf"), back).otherwise(x)  # what overflows is whole anyway


def plus(a, b) -> Column:
    return _col(a) + _or_lit(b)


def minus(a, b) -> Column:
    return _col(a) - _or_lit(b)


def times(a, b) -> Column:
    return _col(a) * _or_lit(b)


def div(a, b) -> Column:
    return ieee_div(_col(a), _or_lit(b))


def negate(a) -> Column:
    return -_col(a)


# ------------------------------------------------------------ text and casts


def concat_text(v: str | Column, suffix: str, *, text_column: bool) -> Column:
    """A column and a constant text. A missing text stays missing; any other missing value reads NA."""
    col = _col(v)
    return F.concat(col if text_column else F.coalesce(col.cast("string"), F.lit("NA")), F.lit(suffix))


def concat_cols(a: str | Column, b: str | Column) -> Column:
    """Two columns end to end; missing if either is."""
    return F.concat(_col(a).cast("string"), _col(b).cast("string"))


def concat_lists(a: str | Column, b: str | Column) -> Column:
    """Two columns with a blank between; a missing value reads null."""
    text = lambda v: F.coalesce(_col(v).cast("string"), F.lit("null"))
    return F.concat_ws(" ", text(a), text(b))


def to_strings(v: str | Column, strict: bool = False) -> Column:
    """As text; with ``strict`` a missing value reads null."""
    col = _col(v).cast("string")
    return F.coalesce(col, F.lit("null")) if strict else col


def to_doubles(v: str | Column) -> Column:
    return _col(v).cast("double")


def to_ints(v: str | Column, kind: str | None = None) -> Column:
    """As integers: floating numbers are rounded half up."""
    col = _col(v)
    return F.floor(col + F.lit(0.5)).cast("int") if kind in ("double", "float") else col.cast("int")


def to_longs(v: str | Column) -> Column:
    return _col(v).cast("bigint")


def to_booleans(v: str | Column) -> Column:
    return _col(v).cast("boolean")


# ------------------------------------------------------------ Python functions, the slow path


def map_values(v: str | Column, fn: Callable, returns: str | DataType) -> Column:
    """A Python function of one value, in Arrow batches; missing values are passed over."""
    run = F.udf(lambda x: None if x is None else fn(x), returns, useArrow=True)
    return run(_col(v))


def map_series(v: str | Column, fn: Callable, returns: str | DataType) -> Column:
    """A vectorised function of a pandas Series."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return fn(s)

    return F.pandas_udf(run, returns)(_col(v))
