"""Grouping and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicatedColumnNameError, NonScalarValueError
from ..functions.deferred import Context, Deferred, resolve
from ..functions.selectors import Selector, resolve_names
from ..grouped import Grouped, Table, frame, keys
from ..names import c, check_known, check_unique, fresh
from ..order import OrderBy
from .verbs import Formula, add_columns

_ROWWISE = "{rowwise}"


def group_by(t: Table, *by: str | Selector, order_by: OrderBy = None) -> Grouped:
    """Group by columns; grouping anew replaces the old keys. Missing values form a group."""
    df = frame(t)
    names = tuple(dict.fromkeys(resolve_names(df, by))) if by else ()
    if order_by is None:
        order = t.order_by if isinstance(t, Grouped) else ()
    else:
        order = tuple(order_by) if isinstance(order_by, (list, tuple)) else (order_by,)
    return Grouped(df, names, order)


def group_by_expr(t: Table, *expressions: Any, **named: Any) -> Grouped:
    """Group by computed keys: group_by_1, group_by_2, ... or the given names."""
    formulas = [(f"group_by_{i}", e) for i, e in enumerate(expressions, 1)] + list(named.items())
    out = add_columns(frame(t), *formulas)
    return group_by(out, *[n for n, _ in formulas])


def rowwise(df: DataFrame) -> Grouped:
    """Each row is a group of its own."""
    return Grouped(df.withColumn(_ROWWISE, F.monotonically_increasing_id()), (_ROWWISE,))


def ungroup(t: Table) -> DataFrame:
    df = frame(t)
    return df.drop(_ROWWISE) if _ROWWISE in df.columns else df


def grouped_by(t: Table) -> DataFrame:
    """The distinct keys; no columns if ungrouped."""
    return frame(t).select(*[c(k) for k in keys(t)]).distinct() if keys(t) else frame(t).select()


def groups(t: Grouped) -> Iterator[DataFrame]:
    """A frame for each group. Fetches the keys (a job), group by group."""
    for row in grouped_by(t).toLocalIterator():
        test = F.lit(True)
        for k in t.by:
            test = test & c(k).eqNullSafe(F.lit(row[k]))
        yield t.df.where(test)


def _summary(df: DataFrame, by: tuple[str, ...], formulas: list[Formula]) -> DataFrame:
    check_unique([*by, *(n for n, _ in formulas)])
    x = Context(df, by, summary=True)
    values = []
    for name, value in formulas:
        col = resolve(value, x)
        if isinstance(value, (list, tuple, set, dict)):
            raise NonScalarValueError(f"{name} is not one value")
        values.append(col.alias(name))
    shown = [c(k) for k in by]
    return df.groupBy(*shown).agg(*values) if by else df.agg(*values)


def summarize(t: Table, *formulas: Formula, **named: Any) -> DataFrame:
    """One row for each group: its keys and the summaries. An empty grouped frame gives no rows."""
    out = _summary(frame(t), keys(t), [*formulas, *named.items()])
    return out.drop(_ROWWISE) if _ROWWISE in out.columns else out


def count(t: Table, *what: str | Selector, name: str = "n") -> DataFrame:
    """Rows by the selected columns, or by the keys, or in all."""
    df = frame(t)
    by = resolve_names(df, what) if what else list(keys(t))
    if name in by:
        raise DuplicatedColumnNameError([name, name])
    return df.groupBy(*[c(k) for k in by]).agg(F.count("*").alias(name)) if by else df.agg(F.count("*").alias(name))


def count_expr(t: Table, *expressions: Any, name: str = "n", **named: Any) -> DataFrame:
    return count(group_by_expr(t, *expressions, **named), name=name)


class At:
    """Collects functions for ``summarize_at``: ``add(mean)``, ``add(median, "med", sep="_")``."""

    def __init__(self):
        self.added: list[tuple[str, str, Callable[[str], Deferred]]] = []

    def add(self, fn: Callable[[str], Deferred], suffix: str | None = None, sep: str = ".") -> At:
        self.added.append((suffix or getattr(fn, "__name__", "value"), sep, fn))
        return self


def summarize_at(
    t: Table,
    what: Selector | Iterable[str],
    *functions: tuple[str, Callable[[str], Deferred]] | Callable[[At], Any],
) -> DataFrame:
    """Every function over every selected column (keys excluded), named ``column.function``."""
    df = frame(t)
    names = resolve_names(df, [what] if isinstance(what, Selector) else what)
    at = At()
    for f in functions:
        if isinstance(f, tuple):
            at.add(f[1], f[0])
        else:
            f(at)
    formulas = [(f"{n}{sep}{suffix}", fn(n)) for suffix, sep, fn in at.added for n in names if n not in keys(t)]
    return _summary(df, keys(t), formulas)


def _in_pandas(t: Grouped, fn: Callable, schema) -> DataFrame:
    """``fn`` over the groups' pandas frames; inside, columns have plain names, as dots confuse Spark here."""
    names = t.columns
    plain = [f"c{i}" for i in range(len(names))]

    def run(g):
        return fn(g.set_axis(names, axis=1))

    return t.df.toDF(*plain).groupBy(*[plain[names.index(k)] for k in t.by]).applyInPandas(run, schema)


def summarize_udf(t: Grouped, fn: Callable, schema: str) -> DataFrame:
    """Whole groups as pandas frames, for what no aggregate can say. A group must fit in memory."""
    return _in_pandas(t, fn, schema)


def transform_groups(t: Grouped, fn: Callable, schema: str | None = None) -> Grouped:
    """A function of each group's pandas frame that returns a frame: whole-column functions that no
    window can say. Groups must fit in memory; the schema is the group's own unless given."""
    return t.with_df(_in_pandas(t, fn, schema or t.df.schema))


def totals_row(df: DataFrame, label_column: str, label: str, *what: str | Selector) -> DataFrame:
    """The frame with a last row that sums up the selected columns."""
    names = resolve_names(df, what)
    check_known(df, [label_column])
    sums = df.agg(*[F.sum(c(n)).alias(n) for n in names]).withColumn(label_column, F.lit(label))
    return df.unionByName(sums, allowMissingColumns=True)


def cube(df: DataFrame, by: Iterable[str], *formulas: Formula, **named: Any) -> DataFrame:
    """Summaries over all subsets of the keys (more than the verbs' grammar asks for)."""
    x = Context(df, tuple(by), summary=True)
    return df.cube(*[c(k) for k in by]).agg(*[resolve(v, x).alias(n) for n, v in [*formulas, *named.items()]])


def rollup(df: DataFrame, by: Iterable[str], *formulas: Formula, **named: Any) -> DataFrame:
    x = Context(df, tuple(by), summary=True)
    return df.rollup(*[c(k) for k in by]).agg(*[resolve(v, x).alias(n) for n, v in [*formulas, *named.items()]])


def salted_summarize(t: Grouped, salt: int, partial: dict[str, Column], final: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Two-step aggregation for keys that hold a large share of the rows and aggregates that Spark can't
    combine map-side: first by key and salt, then by key. ``final`` combines the partial columns."""
    by = [c(k) for k in t.by]
    name = fresh(t.df, "__salt")
    first = t.df.withColumn(name, F.pmod(F.xxhash64(F.struct(*[c(n) for n in t.df.columns])), F.lit(salt)))
    step = first.groupBy(*by, F.col(name)).agg(*[v.alias(n) for n, v in partial.items()])
    return step.groupBy(*by).agg(*[fn(c(n)).alias(n) for n, fn in final.items()])
