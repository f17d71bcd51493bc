"""Single rows, columns and values. They come to the driver; verbs are the way to work on frames."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType

from .errors import ColumnTypeCastError, UnknownColumnError
from .grouped import Table, frame
from .names import c, check_known
from .order import OrderBy
from .operators.verbs import slice_rows


def rows(t: Table) -> Iterator[dict[str, Any]]:
    """Rows as dicts, partition by partition."""
    for r in frame(t).toLocalIterator():
        yield r.asDict(recursive=True)


def row(t: Table, at: int, order_by: OrderBy = None) -> dict[str, Any]:
    """The row at a 0-based position of the order."""
    found = slice_rows(frame(t), at + 1, order_by=order_by).first()
    if at < 0 or found is None:
        raise IndexError(f"no row {at}")
    return found.asDict(recursive=True)


def column(t: Table, which: str | int) -> Column:
    """A column by name or 0-based place."""
    df = frame(t)
    if isinstance(which, int):
        if not -len(df.columns) <= which < len(df.columns):
            raise UnknownColumnError(f"no column {which}; there are {len(df.columns)}")
        which = df.columns[which]
    check_known(df, [which])
    return c(which)


def values(t: Table, which: str | int, order_by: OrderBy = None) -> list[Any]:
    """A column's values as a list, in the given order."""
    from .order import sort_columns

    df = frame(t)
    picked = df.orderBy(*sort_columns(df, order_by)) if order_by is not None else df
    return [r[0] for r in picked.select(column(df, which).alias("v")).collect()]


def as_type(df: DataFrame, name: str, kind: type[DataType]) -> Column:
    """The column, if it has the type."""
    check_known(df, [name])
    found = df.schema[name].dataType
    if not isinstance(found, kind):
        raise ColumnTypeCastError(f"column {name} is {found.simpleString()}, not {kind.__name__}")
    return c(name)


def map_not_null(values_: list, fn) -> list:
    """A function over a Python list that passes over missing values."""
    return [None if v is None else fn(v) for v in values_]
