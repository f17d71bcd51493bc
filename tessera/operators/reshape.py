"""Long and wide, nested and flat."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..errors import DuplicatedColumnNameError, InvalidColumnOperationError
from ..functions.selectors import Selector, resolve_names
from ..grouped import Grouped, Table, frame, keys
from ..names import c, check_known, check_unique
from ..order import OrderBy, order_terms
from ..sources.typeguess import convert_columns
from .bind import common_type
from .grouping import ungroup
from .joins import left_join


def _names(df: DataFrame, what) -> list[str]:
    if what is None:
        return list(df.columns)
    if isinstance(what, (str, Selector)):
        what = [what]
    return resolve_names(df, what)


def spread(t: Table, key: str, value: str, keys_: Iterable | None = None, fill=None, convert: bool = False) -> DataFrame:
    """Long to wide: a column for each key, a row for each combination of the other columns.

    A key may occur once in a row's group; otherwise reading the result raises an error. Missing
    combinations are missing, or ``fill``. Without ``keys_`` the distinct keys are fetched first (a
    job); a missing key makes a column named null. ``convert`` types text columns anew.
    """
    df = ungroup(t)
    check_known(df, [key, value])
    rest = [n for n in df.columns if n not in (key, value)]
    text = F.coalesce(c(key).cast("string"), F.lit("null"))
    if keys_ is None:
        keys_ = sorted((r[0] for r in df.select(text.alias("k")).distinct().collect()))
    names = ["null" if k is None else str(k) for k in keys_]
    if set(names) & set(rest):
        raise DuplicatedColumnNameError([*names, *rest])
    # one aggregate for each key, all in one pass: the exchange is on the other columns only
    cells = []
    for n in names:
        own = text == F.lit(n)
        one = F.when(
            F.count_if(own) > 1, F.raise_error(F.lit("key and value columns don't tell the rows apart"))
        ).otherwise(F.max(F.when(own, c(value))) if _orderable(df, value) else F.first(F.when(own, c(value)), ignorenulls=True))
        if fill is not None:
            one = F.when(F.count_if(own) == 0, F.lit(fill)).otherwise(one)
        cells.append(one.alias(n))
    out = df.groupBy(*[c(n) for n in rest]).agg(*cells) if rest else df.agg(*cells)
    return convert_columns(out, names) if convert else out


def _orderable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant", "struct", "array")


def gather(t: Table, key: str, value: str, what=None, convert: bool = False) -> DataFrame:
    """Wide to long: the selected columns (all by default) become rows of a key and a value. Missing
    values are kept. Whole numbers widen to long, mixes of numbers to double, other mixes to text."""
    df = ungroup(t)
    names = _names(df, what)
    rest = [n for n in df.columns if n not in names]
    check_unique([*rest, key, value])
    kinds = [df.schema[n].dataType for n in names]
    try:
        kind = common_type(kinds)
    except InvalidColumnOperationError:
        kind = common_type([])
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c(n).cast(kind).alias("v")) for n in names])
    out = df.select(*[c(n) for n in rest], F.explode(pairs).alias("__p"))
    out = out.select(*[c(n) for n in rest], F.col("__p.k").alias(key), F.col("__p.v").alias(value))
    return convert_columns(out, [key]) if convert else out


def unite(t: Table, name: str, what, sep: str = "_", remove: bool = True) -> DataFrame:
    """Columns pasted into one, which comes last; missing values read NA."""
    df = ungroup(t)
    names = _names(df, what)
    if not names:
        raise ValueError("nothing to unite")
    new = F.concat_ws(sep, *[F.coalesce(c(n).cast("string"), F.lit("NA")) for n in names])
    rest = [n for n in df.columns if n != name and not (remove and n in names)]
    return df.select(*[c(n) for n in rest], new.alias(name))


def separate(
    t: Table, name: str, into: Iterable[str], sep: str = r"[^\w]", remove: bool = True, convert: bool = False
) -> DataFrame:
    """A text column split by a regular expression. Every text must give as many parts as there are
    names, otherwise reading the result raises an error; a missing text gives missing parts."""
    df, into = ungroup(t), list(into)
    check_known(df, [name])
    parts = F.split(c(name).cast("string"), sep, -1)
    wrong = F.size(parts) != len(into)
    checked = F.when(c(name).isNull(), F.lit(None)).when(
        wrong, F.raise_error(F.lit(f"column {name} doesn't split into {len(into)} parts everywhere"))
    ).otherwise(parts)
    rest = [n for n in df.columns if not (remove and n == name)]
    check_unique([*rest, *into])
    out = df.select(*[c(n) for n in rest], *[checked.getItem(i).alias(n) for i, n in enumerate(into)])
    return convert_columns(out, into) if convert else out


def nest(t: Table, what=None, name: str = "data", order_by: OrderBy = None) -> DataFrame:
    """The selected columns (all but the keys by default) become a nested table, a row for each
    combination of the others. A group's rows come into one value, so groups must fit in memory."""
    df = frame(t)
    inside = _names(df, what) if what is not None else [n for n in df.columns if n not in keys(t)]
    outside = [n for n in df.columns if n not in inside]
    row = F.struct(*[c(n) for n in inside])
    if order_by is None and isinstance(t, Grouped) and t.order_by:
        order_by = t.order_by
    if order_by is None:
        rows = F.collect_list(row)
    else:
        terms = order_terms(df, order_by)
        held = F.collect_list(F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(terms)], row.alias("r")))

        def earlier(a: Column, b: Column) -> Column:
            """-1, 0 or 1, of keys of any type, nulls last."""
            out = F.lit(0)
            for i, (_, up) in reversed(list(enumerate(terms))):
                x, y = a[f"k{i}"], b[f"k{i}"]
                by_value = F.when((x < y) if up else (x > y), F.lit(-1)).when((x > y) if up else (x < y), F.lit(1)).otherwise(out)
                out = F.when(x.isNull(), F.when(y.isNull(), out).otherwise(F.lit(1))).when(y.isNull(), F.lit(-1)).otherwise(by_value)
            return out

        rows = F.transform(F.array_sort(held, earlier), lambda x: x["r"])
    return df.groupBy(*[c(n) for n in outside]).agg(rows.alias(name)) if outside else df.agg(rows.alias(name))


def unnest(t: Table, name: str) -> DataFrame:
    """Nested tables or lists to rows; nested columns come last. A missing table gives one row of
    missing values, an empty one none."""
    df = ungroup(t)
    kind = df.schema[name].dataType
    if not isinstance(kind, ArrayType):
        raise InvalidColumnOperationError(f"{name} is no list column")
    rest = [n for n in df.columns if n != name]
    missing = F.when(c(name).isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(c(name))
    out = df.select(*[c(n) for n in rest], F.explode(missing).alias("__e"))
    if isinstance(kind.elementType, StructType):
        check_unique([*rest, *kind.elementType.names])
        return out.select(*[c(n) for n in rest], *[F.col("__e").getField(n).alias(n) for n in kind.elementType.names])
    return out.withColumnRenamed("__e", name)


def expand(t: Table, *columns: str) -> DataFrame:
    """All combinations of the columns' distinct values, sorted. The result is their cross product by
    definition; each side is a distinct list."""
    return _combinations(ungroup(t), columns).orderBy(*[c(n).asc_nulls_last() for n in columns])


def _combinations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    check_known(df, columns)
    return reduce(DataFrame.crossJoin, [df.select(c(n)).distinct() for n in columns])


def complete(t: Table, *columns: str) -> DataFrame:
    """The frame with a row for every combination of the columns' values."""
    df = ungroup(t)
    return left_join(_combinations(df, columns), df, list(columns))


def unfold(
    t: Table, name: str, fields: Iterable[str] | None = None, keep: bool = True, add_prefix: bool = False
) -> DataFrame:
    """Fields of a struct column as columns of their own."""
    df = ungroup(t)
    kind = df.schema[name].dataType
    if not isinstance(kind, StructType):
        raise InvalidColumnOperationError(f"{name} is no record column")
    fields = list(fields) if fields is not None else kind.names
    rest = [n for n in df.columns if keep or n != name]
    new = [f"{name}.{f}" if add_prefix else f for f in fields]
    check_unique([*rest, *new])
    return df.select(*[c(n) for n in rest], *[c(name).getField(f).alias(n) for f, n in zip(fields, new, strict=True)])


def flatten(t: Table) -> DataFrame:
    """Lists to rows and records to columns, until neither is left. Names that clash are prefixed."""
    df = ungroup(t)
    while True:
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
        if lists:
            kind = df.schema[lists[0]].dataType.elementType
            if isinstance(kind, StructType):
                df = df.withColumn(lists[0], F.explode_outer(c(lists[0])))
            else:
                df = unnest(df, lists[0])
            continue
        records = [f for f in df.schema.fields if isinstance(f.dataType, StructType)]
        if not records:
            return df
        name, taken = records[0].name, set(df.columns)
        df = unfold(df, name, keep=False, add_prefix=any(n in taken - {name} for n in records[0].dataType.names))
