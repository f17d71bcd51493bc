"""Putting frames below or beside each other."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NumericType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

from ..errors import InvalidColumnOperationError
from ..grouped import Table
from ..names import c, check_unique, without_clashes
from ..order import OrderBy, with_index
from .grouping import ungroup

_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def common_type(types: Sequence[DataType]) -> DataType:
    """Equal types stay; whole numbers widen to long, other mixes of numbers to double, anything with
    text to text; booleans and numbers don't mix."""
    types = list(dict.fromkeys(t for t in types if t.typeName() != "void"))
    if not types:
        return StringType()
    if len(types) == 1:
        return types[0]
    if any(isinstance(t, StringType) for t in types):
        return StringType()
    if all(isinstance(t, _WHOLE) for t in types):
        return LongType()
    if all(isinstance(t, NumericType) for t in types):
        decimal = all(isinstance(t, (DecimalType, *_WHOLE)) for t in types)
        return max((t for t in types if isinstance(t, DecimalType)), key=lambda t: t.precision) if decimal else DoubleType()
    if any(isinstance(t, BooleanType) for t in types) and any(isinstance(t, (NumericType, FloatType)) for t in types):
        raise InvalidColumnOperationError("booleans and numbers can't be put into one column")
    raise InvalidColumnOperationError(f"types can't be put into one column: {[t.simpleString() for t in types]}")


def bind_rows(*tables: Table | dict[str, Any]) -> DataFrame:
    """Rows of all frames (or dicts), by column name. Missing columns are filled with missing values;
    columns come in the order in which they are first seen; types widen as ``common_type`` says."""
    frames = [ungroup(t) for t in tables if not isinstance(t, dict)]
    rows = [t for t in tables if isinstance(t, dict)]
    if rows:
        from ..sources.builders import from_records

        if not frames:
            raise ValueError("at least one frame is needed")
        known = {f.name: f.dataType for f in frames[0].schema.fields}
        # one frame for each set of names, so that the rest is missing
        frames += [from_records(frames[0].sparkSession, [r], types=known) for r in rows]
    names = list(dict.fromkeys(n for f in frames for n in f.columns))
    kinds = {n: common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}

    def fitted(f: DataFrame) -> DataFrame:
        return f.select(*[(c(n).cast(kinds[n]) if n in f.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])

    return reduce(DataFrame.unionByName, map(fitted, frames))


def add_row(df: DataFrame, row: Sequence[Any]) -> DataFrame:
    """One row by position."""
    if len(row) != len(df.columns):
        raise ValueError(f"{len(row)} values for {len(df.columns)} columns")
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields])
    return df.union(df.sparkSession.createDataFrame([tuple(row)], schema))


def bind_cols(
    left: DataFrame, right: DataFrame, rename_duplicates: bool = True, left_order: OrderBy = None, right_order: OrderBy = None
) -> DataFrame:
    """Rows side by side, by position in the given orders. Both must have as many rows; where one has
    none left, reading the result raises an error. Positions are joined, so both sides stay spread."""
    names = without_clashes(left.columns, right.columns) if rename_duplicates else check_unique([*left.columns, *right.columns])[len(left.columns) :]
    l_, r_ = with_index(left, left_order, "__at"), with_index(right, right_order, "__at")
    l_ = l_.select(F.col("__at").alias("__l"), *[c(n) for n in left.columns])
    r_ = r_.select(F.col("__at").alias("__r"), *[c(n).alias(m) for n, m in zip(right.columns, names, strict=True)])
    both = l_.join(r_, F.col("__l") == F.col("__r"), "full_outer")
    uneven = F.col("__l").isNull() | F.col("__r").isNull()
    checked = both.where(F.when(uneven, F.raise_error(F.lit("frames differ in their number of rows")).cast("boolean")).otherwise(True))
    return checked.select(*[c(n) for n in [*left.columns, *names]])


def bind_columns(frames: Iterable[DataFrame], order_by: OrderBy = None) -> DataFrame:
    frames = list(frames)
    return reduce(lambda a, b: bind_cols(a, b, left_order=order_by, right_order=order_by), frames)
