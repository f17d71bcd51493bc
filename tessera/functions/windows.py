"""Positional functions: they follow the row order of the group, or of the whole frame."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..order import Desc, OrderBy, Ranges, window, with_index
from .deferred import Context, Deferred, as_column, row_number
from .exprs import ieee_div

_FIRST, _HERE = Window.unboundedPreceding, Window.currentRow


def _shifted(value: str | Column, n: int, default, back: bool) -> Deferred:
    def build(x: Context) -> Column:
        col = as_column(value, x)

        def whole(df: DataFrame, name: str) -> DataFrame:
            # positions are joined, so no task sees more than its share
            at = with_index(df, x.order_by, "__at")
            from_ = F.col("__at") + (n if back else -n)
            other = at.select(from_.alias("__at"), col.alias(name), F.lit(True).alias("__hit"))
            out = at.join(other, "__at", "left")
            if default is not None:
                out = out.withColumn(name, F.when(F.col("__hit").isNull(), F.lit(default)).otherwise(F.col(name)))
            return out.drop("__at", "__hit")

        return x.positional(lambda g: g.over((F.lag if back else F.lead)(col, n, default)), whole)

    return Deferred(build)


def lead(value: str | Column, n: int = 1, default=None) -> Deferred:
    return _shifted(value, n, default, back=False)


def lag(value: str | Column, n: int = 1, default=None) -> Deferred:
    return _shifted(value, n, default, back=True)


def cum_sum(value: str | Column) -> Deferred:
    """Running sum; a missing value makes itself and all that follow missing."""

    def build(x: Context) -> Column:
        col = as_column(value, x)

        def grouped(g: Context) -> Column:
            gone = g.over(F.max(col.isNull()), frame=(_FIRST, _HERE))
            return F.when(~gone, g.over(F.sum(col), frame=(_FIRST, _HERE)))

        def whole(df: DataFrame, name: str) -> DataFrame:
            r = Ranges(df, x.order_by)
            wide = r.carried(
                {"__s": F.sum(col), "__g": F.max(col.isNull())},
                {"__s": F.sum("__s").over(r.before()), "__g": F.max("__g").over(r.before())},
            )
            w = r.window().rowsBetween(_FIRST, _HERE)
            gone = F.coalesce(F.col("__g"), F.lit(False)) | F.max(col.isNull()).over(w)
            own = F.sum(col).over(w)
            return wide.withColumn(name, F.when(~gone, own + F.coalesce(F.col("__s"), F.lit(0)))).drop("__s", "__g", r.name)

        return x.positional(grouped, whole)

    return Deferred(build)


def pct_change(value: str | Column) -> Deferred:
    """Change against the row before, as a share of it."""
    before = lag(value)
    return Deferred(lambda x: ieee_div(as_column(value, x), before.build(x)) + F.lit(-1.0))


def rank(value: str | Column, na_last: bool = True) -> Deferred:
    """0-based ordinal rank; ties rank by the order of rows."""

    def build(x: Context) -> Column:
        col = as_column(value, x)
        key = col.asc_nulls_last() if na_last else col.asc_nulls_first()

        def grouped(g: Context) -> Column:
            w = Window.partitionBy(*[g[k] for k in g.by]).orderBy(key, *_ties(g.df, g.order_by))
            return F.row_number().over(w) - 1

        def whole(df: DataFrame, name: str) -> DataFrame:
            lead_ = [] if na_last else [Desc(col.isNull().cast("int"))]
            more = x.order_by if x.order_by is not None else ([] if not _ties(df, None) else ["__rid"])
            more = [more] if isinstance(more, (str, Column, Desc)) else list(more)
            return with_index(df, [*lead_, col, *more], name).withColumn(name, F.col(name) - 1)

        return x.positional(grouped, whole)

    return Deferred(build)


def _ties(df: DataFrame, order_by: OrderBy) -> list[Column]:
    from ..errors import OrderRequiredError
    from ..order import sort_columns

    try:
        return sort_columns(df, order_by)
    except OrderRequiredError:
        return []


def order_positions(df: DataFrame, value: str, order_by: OrderBy = None, na_last: bool = True) -> list[int]:
    """The 0-based positions of the rows in the order of a column. Comes to the driver, as any Python list."""
    at = with_index(df, order_by, "__at").select((F.col("__at") - 1).alias("at"), F.col(f"`{value}`").alias("v"))
    key = F.col("v").asc_nulls_last() if na_last else F.col("v").asc_nulls_first()
    return [r["at"] for r in at.orderBy(key, "at").collect()]


def list_cum_sum(values) -> list:
    return list(accumulate(values))


DOWN, UP, DOWN_UP, UP_DOWN = "down", "up", "downup", "updown"


def filled(value: str | Column, direction: str = DOWN) -> Deferred:
    """Missing values from the last value before (down), the next one after (up), or both in turn."""
    if direction == DOWN_UP:
        return _either(filled(value, DOWN), filled(value, UP))
    if direction == UP_DOWN:
        return _either(filled(value, UP), filled(value, DOWN))

    def build(x: Context) -> Column:
        col = as_column(value, x)
        down = direction == DOWN

        def grouped(g: Context) -> Column:
            # upwards is downwards from the end: a frame that grows takes one step for each row, while
            # one that shrinks is computed anew for each
            return g.over(F.last(col, ignorenulls=True), frame=(_FIRST, _HERE), back=not down)

        def whole(df: DataFrame, name: str) -> DataFrame:
            r = Ranges(df, x.order_by)
            terms = r.terms
            if all(up or _is_number(df, k) for k, up in terms):
                seen = F.when(col.isNotNull(), F.struct(*[_orderable(k, up) for k, up in terms]))
                edge = F.max_by(col, seen) if down else F.min_by(col, seen)
            else:  # a key that can't be negated: the ranges' last values by a window of their own
                whole_range = r.window(back=not down).rowsBetween(_FIRST, Window.unboundedFollowing)
                r.df = r.df.withColumn("__edge", F.last(col, ignorenulls=True).over(whole_range))
                edge = F.first("__edge")
            over = (
                F.last("__v", ignorenulls=True).over(r.before()) if down else F.first("__v", ignorenulls=True).over(r.after())
            )
            wide = r.carried({"__v": edge}, {"__v": over})
            own = F.last(col, ignorenulls=True).over(r.window(back=not down).rowsBetween(_FIRST, _HERE))
            return wide.withColumn(name, F.coalesce(own, F.col("__v"))).drop("__v", "__edge", r.name)

        return x.positional(grouped, whole)

    return Deferred(build)


def _orderable(key: Column, up: bool) -> Column:
    """Larger for later rows: nulls come last; a descending key must be a number."""
    return F.struct(key.isNull().alias("none"), (key if up else -key).alias("value"))


def _is_number(df: DataFrame, key: Column) -> bool:
    return isinstance(df.select(key).schema.fields[0].dataType, NumericType)


def _either(a: Deferred, b: Deferred) -> Deferred:
    return Deferred(lambda x: F.coalesce(a.build(x), b.build(x)))


__all__ = [
    "DOWN", "DOWN_UP", "UP", "UP_DOWN", "cum_sum", "filled", "lag", "lead", "list_cum_sum", "order_positions",
    "pct_change", "rank", "row_number", "window",
]
