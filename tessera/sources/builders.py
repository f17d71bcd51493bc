"""Frames from Python values and objects, and back."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from ..names import ROW_ID, c, check_unique, valid_identifier

_INT = range(-(2**31), 2**31)


def value_type(values: Iterable[Any]) -> DataType:
    """The type of a list: int, long, text, double, boolean, or double for mixed numbers. A list
    without values is text; anything mixed is text as well."""
    values = [v for v in values if v is not None]
    if not values:
        return StringType()
    if all(isinstance(v, bool) for v in values):
        return BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return IntegerType() if all(v in _INT for v in values) else LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return DoubleType()
    if all(isinstance(v, decimal.Decimal) for v in values):
        return DecimalType(38, 18)
    if all(isinstance(v, dt.datetime) for v in values):
        return TimestampNTZType()
    if all(isinstance(v, dt.date) for v in values):
        return DateType()
    if all(isinstance(v, (list, tuple)) for v in values):
        return ArrayType(value_type(x for v in values for x in v))
    if all(isinstance(v, dict) for v in values):
        names = list(dict.fromkeys(k for v in values for k in v))
        return StructType([StructField(n, value_type(v.get(n) for v in values)) for n in names])
    if all(dataclasses.is_dataclass(v) for v in values):
        return value_type([_fields(v) for v in values])
    return StringType()


def _fitted(v: Any, kind: DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, DoubleType):
        return float(v)
    if isinstance(kind, StringType) and not isinstance(v, str):
        return str(v)
    if isinstance(kind, ArrayType):
        return [_fitted(x, kind.elementType) for x in v]
    if isinstance(kind, StructType):
        v = _fields(v) if dataclasses.is_dataclass(v) else v
        return tuple(_fitted(v.get(f.name), f.dataType) for f in kind.fields)
    return v


def _frame(spark: SparkSession, names: list[str], columns: list[list], types: dict[str, DataType] | None = None, row_id: bool = False) -> DataFrame:
    check_unique(names)
    kinds = [(types or {}).get(n) or value_type(col) for n, col in zip(names, columns, strict=True)]
    rows = [tuple(_fitted(v, k) for v, k in zip(r, kinds, strict=True)) for r in zip(*columns, strict=True)]
    fields = [StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    if row_id:
        rows, fields = [(*r, i) for i, r in enumerate(rows)], [*fields, StructField(ROW_ID, LongType())]
    return spark.createDataFrame(rows, StructType(fields))


def frame_of(spark: SparkSession, names: Iterable[str], values: Iterable[Any], row_id: bool = False) -> DataFrame:
    """A literal table, row by row: ``frame_of(spark, ["a", "b"], [1, "x", 2, "y"])``."""
    names, values = list(names), list(values)
    if not values:
        raise ValueError("there are no values")
    if len(values) % len(names):
        raise ValueError(f"{len(values)} values don't fill rows of {len(names)}")
    return _frame(spark, names, [values[i :: len(names)] for i in range(len(names))], row_id=row_id)


def from_columns(spark: SparkSession, columns: dict[str, Iterable[Any]], row_id: bool = False) -> DataFrame:
    columns = {n: list(v) for n, v in columns.items()}
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    return _frame(spark, list(columns), list(columns.values()), row_id=row_id) if columns else empty_frame(spark)


def from_records(spark: SparkSession, records: Iterable[dict[str, Any]], types: dict[str, DataType] | None = None, row_id: bool = False) -> DataFrame:
    """Dicts; the first one's keys are the columns."""
    records = list(records)
    if not records:
        return empty_frame(spark)
    names = list(records[0])
    return _frame(spark, names, [[r.get(n) for r in records] for n in names], types, row_id)


def deparse_records(spark: SparkSession, objects: Iterable[Any], **extract: Callable[[Any], Any]) -> DataFrame:
    """Objects through one function for each column."""
    objects = list(objects)
    return _frame(spark, list(extract), [[f(o) for o in objects] for f in extract.values()])


def _fields(o: Any) -> dict[str, Any]:
    if dataclasses.is_dataclass(o):
        names = [f.name for f in dataclasses.fields(o)]
    else:
        names = [n for n in vars(o) if not n.startswith("_")]
    return {n: getattr(o, n) for n in sorted(names)}


def from_objects(spark: SparkSession, objects: Iterable[Any]) -> DataFrame:
    """Objects by their fields, in alphabetical order; nested data classes become records."""
    return from_records(spark, [_fields(o) for o in objects])


def empty_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType([]))


def rows_as(df: DataFrame, cls: type, mapping: dict[str, str] | None = None) -> Iterator[Any]:
    """Rows as objects of a data class; ``mapping`` gives columns for fields that are named otherwise."""
    mapping = mapping or {}
    names = [f.name for f in dataclasses.fields(cls)]
    missing = [n for n in names if mapping.get(n, n) not in df.columns and _required(cls, n)]
    if missing:
        raise TypeError(f"{cls.__name__} needs columns {missing}")
    have = [n for n in names if mapping.get(n, n) in df.columns]
    for row in df.select(*[c(mapping.get(n, n)).alias(n) for n in have]).toLocalIterator():
        yield cls(**row.asDict())


def _required(cls: type, name: str) -> bool:
    f = next(f for f in dataclasses.fields(cls) if f.name == name)
    return f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING


_PYTHON = {"integer": "int", "long": "int", "double": "float", "float": "float", "boolean": "bool", "string": "str", "date": "date", "timestamp_ntz": "datetime", "timestamp": "datetime"}


def data_class_source(df: DataFrame, name: str) -> str:
    """Source text of a data class that fits the frame; fields with missing values are optional (a job)."""
    gone = df.agg(*[F.coalesce(F.bool_or(c(f.name).isNull()), F.lit(False)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]).first()
    lines = ["@dataclass", f"class {name}:"]
    for i, f in enumerate(df.schema.fields):
        kind = _PYTHON.get(f.dataType.typeName(), "Any")
        lines.append(f"    {valid_identifier(f.name)}: {kind}{' | None' if gone[f'n{i}'] else ''}")
    return "\n".join(lines)


def to_map(df: DataFrame) -> dict[str, list]:
    """Columns as lists, on the driver."""
    t = df.toArrow()
    return {n: t.column(i).to_pylist() for i, n in enumerate(t.column_names)}


def to_matrix(df: DataFrame, dtype: str = "float64"):
    """A column-major numpy matrix; numeric columns without missing values only. Comes to the driver."""
    import numpy as np

    from ..errors import InvalidColumnOperationError, MissingValueError

    odd = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("integer", "long", "double", "float", "short", "byte")]
    if odd:
        raise InvalidColumnOperationError(f"columns are not numeric: {odd}")
    t = df.toArrow()
    if any(col.null_count for col in t.columns):
        raise MissingValueError("missing values have no place in a matrix")
    return np.asfortranarray(np.stack([col.to_numpy() for col in t.columns], axis=1).astype(dtype)) if t.num_columns else np.zeros((0, 0), dtype)
