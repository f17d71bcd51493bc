"""Row order. Frames have none of their own, so verbs that need one are told the columns to order by.

Without grouping keys a plain window would move every row to one task. Here the rows are cut into
ranges of all order keys together (the bounds come from a bounded sample, so they are fixed when the
plan is built, and a range number depends on a row's values alone); a window works inside each range,
and one small row for each range carries over what came before it. Rows that tie in every key are told
apart by a hash of the whole row where they are many, so that a coarse order has ranges too; only rows
that are equal throughout share one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DayTimeIntervalType,
    MapType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from .errors import OrderRequiredError
from .names import ROW_ID, c, check_known, fresh

#: Rows that bounds are chosen from, at least, and for each range.
SAMPLE, PER_RANGE = 4096, 20

#: Types that a bound can be a literal of; keys from the first other one on don't cut ranges.
_CUTTING = (StringType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType, NumericType, DayTimeIntervalType)

OrderBy = Iterable["str | Column"] | str | Column | None


class Desc:
    """Descending order, nulls last."""

    def __init__(self, key: str | Column):
        self.key = key


def desc(key: str | Column) -> Desc:
    return Desc(key)


def order_terms(df: DataFrame, order_by: OrderBy) -> list[tuple[Column, bool]]:
    """(expression, ascending) of each key; falls back to the row number column."""
    if order_by is None or (isinstance(order_by, (tuple, list)) and not order_by):
        if ROW_ID not in df.columns:
            raise OrderRequiredError("say what to order by: the result depends on the order of rows")
        order_by = [ROW_ID]
    if isinstance(order_by, (str, Column, Desc)):
        order_by = [order_by]
    out = []
    for key in order_by:
        up = not isinstance(key, Desc)
        key = key.key if isinstance(key, Desc) else key
        if isinstance(key, str):
            check_known(df, [key])
            key = c(key)
        out.append((key, up))
    return out


def sort_columns(df: DataFrame, order_by: OrderBy) -> list[Column]:
    """Sort expressions, nulls last either way."""
    return [k.asc_nulls_last() if up else k.desc_nulls_last() for k, up in order_terms(df, order_by)]


def reversed_columns(df: DataFrame, order_by: OrderBy) -> list[Column]:
    """The exact reverse of ``sort_columns``."""
    return [k.desc_nulls_first() if up else k.asc_nulls_first() for k, up in order_terms(df, order_by)]


def window(df: DataFrame, by: Iterable[str], order_by: OrderBy, *, back: bool = False) -> WindowSpec:
    terms = reversed_columns(df, order_by) if back else sort_columns(df, order_by)
    return Window.partitionBy(*[c(k) for k in by]).orderBy(*terms)


def _sorted_sample(keys: DataFrame, ups: list[bool], rows: int) -> list[tuple]:
    """About so many rows at most, in order. Counting them first is a job of its own."""
    total = keys.count()
    if total > rows:
        keys = keys.where(F.rand(17) < rows / total)
    order = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in zip(keys.columns, ups, strict=True)]
    # the sample is bounded, so one task sorts it
    return [tuple(r) for r in keys.repartition(1).sortWithinPartitions(*order).collect()]


def _same(a: tuple, b: tuple) -> bool:
    return repr(a) == repr(b)  # values that aren't numbers are equal to themselves


def _row_hash(df: DataFrame) -> Column:
    def hashes(kind: DataType) -> bool:
        inner = [f.dataType for f in getattr(kind, "fields", [])] + [getattr(kind, "elementType", None)]
        return not isinstance(kind, MapType) and kind.typeName() != "variant" and all(hashes(k) for k in inner if k is not None)

    return F.xxhash64(F.lit(5), *[c(f.name) for f in df.schema.fields if hashes(f.dataType)])


def _position(keys: list[tuple[Column, bool]], bounds: list[tuple], kinds: list[DataType]) -> Column:
    """How many of the sorted bounds a row is at or past: a binary search in literal arrays, so neither
    the expression nor the work on a row grows with their number (but by its logarithm)."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    held = [F.array(*[F.lit(b[i]) for b in bounds]).cast(ArrayType(kind)) for i, kind in enumerate(kinds)]

    def reached(at: Column) -> Column:
        out = F.lit(True)
        for (key, up), values in reversed(list(zip(keys, held, strict=True))):
            bound = F.get(values, at)
            past = (key.isNull() & bound.isNotNull()) | F.coalesce(key > bound if up else key < bound, F.lit(False))
            out = past | (key.eqNullSafe(bound) & out)
        return out

    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & reached(at + step - 1), at + step).otherwise(at),
    )


class Ranges:
    """A frame cut into ranges of its order keys, about as many as shuffle partitions unless ``n`` says
    otherwise. Building it runs two small jobs, or three. ``ties`` tells rows apart that are equal in all
    keys, where they are many."""

    def __init__(self, df: DataFrame, order_by: OrderBy, n: int | None = None, ties: bool = True):
        self.name = fresh(df, "__range")
        self.terms = order_terms(df, order_by)
        n = max(1, n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = max(SAMPLE, PER_RANGE * n)
        keys, kinds, found = self._keys(df), [], []
        if n > 1 and keys:
            sample = lambda: _sorted_sample(df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]), [up for _, up in keys], rows)
            found = sample()
            most = len(found) // n + 1  # rows of a range; more ties than that don't fit in one
            if ties and len(keys) == len(self.terms) and any(_same(a, b) for a, b in zip(found, found[most:], strict=False)):
                self.terms.append((_row_hash(df), True))
                keys = self._keys(df)
                found = sample()
            kinds = [f.dataType for f in df.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).schema.fields]
        cuts = [found[len(found) * i // n] for i in range(1, n)] if found else []
        bounds = [b for i, b in enumerate(cuts) if not i or not _same(b, cuts[i - 1])]
        # not deterministic by its form only: the optimizer may not carry the expression over to the other
        # side of a join on the range (it lost the columns that the lambda refers to there)
        number = F.when(F.spark_partition_id() < 0, F.lit(-1)).otherwise(_position(keys, bounds, kinds))
        self.df = df.withColumn(self.name, number)

    def _keys(self, df: DataFrame) -> list[tuple[Column, bool]]:
        """The keys that cut, each in a form whose literals compare as the key does."""
        out = []
        for (key, up), f in zip(self.terms, df.select(*[k.alias("k") for k, _ in self.terms]).schema.fields, strict=True):
            if not isinstance(f.dataType, _CUTTING):
                break
            out.append((F.unix_micros(key) if isinstance(f.dataType, TimestampType) else key, up))
        return out

    def window(self, *, back: bool = False) -> WindowSpec:
        terms = [
            (k.desc_nulls_first() if up else k.asc_nulls_first()) if back else (k.asc_nulls_last() if up else k.desc_nulls_last())
            for k, up in self.terms
        ]
        return Window.partitionBy(c(self.name)).orderBy(*terms)

    def carried(self, per_range: dict[str, Column], over: dict[str, Column]) -> DataFrame:
        """The frame with columns that sum up all ranges before a row's own. ``per_range`` are aggregates
        of a range; ``over`` turns them into what is carried, in a window over the ranges."""
        small = self.df.groupBy(c(self.name)).agg(*[a.alias(n) for n, a in per_range.items()])
        small = small.select(c(self.name), *[o.alias(n) for n, o in over.items()])
        # one row for each range, of which there are no more than shuffle partitions
        return self.df.join(F.broadcast(small), self.name, "left")

    def before(self) -> WindowSpec:
        """Over the ranges' own rows: all ranges before. So few rows that one task is right."""
        return Window.orderBy(c(self.name)).rowsBetween(Window.unboundedPreceding, -1)

    def after(self) -> WindowSpec:
        return Window.orderBy(c(self.name)).rowsBetween(1, Window.unboundedFollowing)


def with_index(df: DataFrame, order_by: OrderBy, name: str = "__index") -> DataFrame:
    """The 1-based position of every row in the given order (ties in any order)."""
    r = Ranges(df, order_by)
    wide = r.carried({"__n": F.count("*")}, {"__before": F.coalesce(F.sum("__n").over(r.before()), F.lit(0))})
    out = wide.withColumn(name, F.row_number().over(r.window()) + F.col("__before"))
    return out.drop("__before", r.name)


def with_row_id(df: DataFrame) -> DataFrame:
    """Numbers rows as they come (files in order of path, rows in order of place)."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())
