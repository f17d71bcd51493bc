"""Column and row verbs. Every verb takes a frame or a ``Grouped`` and is lazy unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField

from ..errors import InvalidColumnOperationError, InvalidSortingPredicateError
from ..functions.deferred import Context, Deferred, resolve
from ..functions.selectors import Selector, by_type, everything, resolve_names, where_
from ..functions.windows import DOWN, filled
from ..grouped import Grouped, Table, frame, keys, rewrap
from ..names import ROW_ID, c, check_known, check_unique, quoted
from ..order import Desc, OrderBy, desc, reversed_columns, sort_columns, window, with_index

Formula = tuple[str, Any]


def _no_stream(df: DataFrame, verb: str) -> None:
    if df.isStreaming:
        raise InvalidColumnOperationError(f"{verb} depends on the order of rows and can't run on a stream")


def _order(t: Table, order_by: OrderBy) -> OrderBy:
    if order_by is None and isinstance(t, Grouped) and t.order_by:
        return t.order_by
    return order_by


def _context(t: Table, order_by: OrderBy = None) -> Context:
    return Context(frame(t), keys(t), _order(t, order_by))


# ------------------------------------------------------------ columns


def select(t: Table, *what: str | Selector | Iterable[str]) -> Table:
    """Keep columns, by name or selector; the keys of a grouped frame come first in any case."""
    flat: list = []
    for w in what:
        flat += [w] if isinstance(w, (str, Selector)) else list(w)
    df = frame(t)
    names = resolve_names(df, flat) if flat else []
    names = [*(k for k in keys(t) if k not in names), *names]
    return rewrap(t, df.select(*[c(n) for n in names]))


def select_if(t: Table, test: Callable[[StructField], bool]) -> Table:
    return select(t, where_(test))


def select_type(t: Table, *types: type[DataType]) -> Table:
    return select(t, by_type(*types))


def remove(t: Table, *what: str | Selector | Iterable[str]) -> Table:
    """Drop columns; unknown names are passed over, keys of a grouped frame are not."""
    flat: list = []
    for w in what:
        flat += [w] if isinstance(w, (str, Selector)) else list(w)
    df, gone = frame(t), []
    for w in flat:
        gone += [w] if isinstance(w, str) else resolve_names(df, [w])
    held = [k for k in keys(t) if k in gone]
    if held:
        raise InvalidColumnOperationError(f"grouping columns can't be removed: {held}")
    return rewrap(t, df.select(*[c(n) for n in df.columns if n not in gone]))


def remove_if(t: Table, test: Callable[[StructField], bool]) -> Table:
    return remove(t, where_(test))


def remove_type(t: Table, *types: type[DataType]) -> Table:
    return remove(t, by_type(*types))


def rename(t: Table, mapping: dict[str, str] | None = None, **more: str) -> Table:
    """Old names to new ones, all at once (so two names can be swapped); places are kept."""
    mapping = {**(mapping or {}), **more}
    df = frame(t)
    check_known(df, mapping)
    new = check_unique([mapping.get(n, n) for n in df.columns])
    out = df.select(*[c(n).alias(m) for n, m in zip(df.columns, new, strict=True)])
    if isinstance(t, Grouped):
        return Grouped(out, tuple(mapping.get(k, k) for k in t.by), t.order_by)
    return out


def set_names(df: DataFrame, *names: str) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*check_unique(names))


def _with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        return df.select(*[value.alias(n) if n == name else c(n) for n in df.columns])
    return df.select("*", value.alias(name))


def add_column(t: Table, name: str, value: Any, order_by: OrderBy = None) -> Table:
    """Add a column, or put one in the place of its old self. ``value`` may be a Column, a constant, a
    deferred expression, or a function of the context; aggregates in it cover the row's group."""
    if name in keys(t):
        raise InvalidColumnOperationError(f"{name} is a grouping column")
    x = _context(t, order_by)
    col = resolve(value, x)
    return rewrap(t, x.apply({name: col}, lambda df, v: _with_column(df, name, v[name])))


def add_columns(t: Table, *formulas: Formula, order_by: OrderBy = None, **named: Any) -> Table:
    """Several columns in turn; later ones see earlier ones."""
    for name, value in [*formulas, *named.items()]:
        t = add_column(t, name, value, order_by)
    return t


def transmute(t: Table, *formulas: Formula, order_by: OrderBy = None, **named: Any) -> Table:
    """Only the new columns (and grouping keys)."""
    new = [name for name, _ in [*formulas, *named.items()]]
    return select(add_columns(t, *formulas, order_by=order_by, **named), *dict.fromkeys(new))


def add_row_number(t: Table, name: str = "row_number", order_by: OrderBy = None) -> Table:
    """1-based row number, leftmost."""
    from ..functions.windows import row_number

    df = frame(t)
    _no_stream(df, "add_row_number")
    return move_left(add_column(t, name, row_number(), order_by), name)


def move_left(t: Table, *names: str) -> Table:
    df = frame(t)
    check_known(df, names)
    return rewrap(t, df.select(*[c(n) for n in [*names, *(n for n in df.columns if n not in names)]]))


def move_right(t: Table, *names: str) -> Table:
    df = frame(t)
    check_known(df, names)
    return rewrap(t, df.select(*[c(n) for n in [*(n for n in df.columns if n not in names), *names]]))


def insert_column(df: DataFrame, at: int, name: str, value: Any) -> DataFrame:
    """A new column at a 0-based place."""
    out = add_column(df, name, value)
    names = [n for n in out.columns if n != name]
    return out.select(*[c(n) for n in [*names[:at], name, *names[at:]]])


def one_hot(
    df: DataFrame, name: str, categories: Iterable | None = None, na_value: str = "NA", categorize: Callable[[Column], Column] | None = None
) -> DataFrame:
    """A 0/1 column for each value, named ``name[value]``; the source goes. ``categorize`` makes text of
    other columns (a plain cast by default). Without ``categories`` the distinct values are fetched
    first (a job)."""
    check_known(df, [name])
    text = F.coalesce((categorize(c(name)) if categorize else c(name)).cast("string"), F.lit(na_value))
    if categories is None:
        categories = sorted(r[0] for r in df.select(text.alias("v")).distinct().collect())
    new = [(text == F.lit(str(v))).cast("int").alias(f"{name}[{v}]") for v in categories]
    return df.select(*[c(n) for n in df.columns if n != name], *new)


def as_factor(df: DataFrame, name: str, order_by: OrderBy = None) -> DataFrame:
    """A text column to (index, levels), levels in the order of first appearance. The levels are fetched
    first (a job); they must be few, as each row refers to all of them."""
    at = with_index(df, order_by, "__at")
    rows = at.where(c(name).isNotNull()).groupBy(c(name).alias("v")).agg(F.min("__at").alias("at")).orderBy("at").collect()
    levels = F.array(*[F.lit(r["v"]) for r in rows]).cast("array<string>")
    index = F.when(c(name).isNotNull(), F.array_position(levels, c(name)).cast("int") - 1)
    return _with_column(df, name, F.struct(index.alias("index"), levels.alias("levels")))


# ------------------------------------------------------------ rows


def filter_rows(t: Table, *predicates: Any, order_by: OrderBy = None) -> Table:
    """Rows for which all predicates hold (missing is no). Aggregates in them cover the row's group."""
    for p in predicates:
        x = _context(t, order_by)
        col = resolve(p, x)
        if x.made or _has_window(col):
            t = rewrap(t, x.apply({"__keep": col}, _filter_by))
        else:
            t = rewrap(t, frame(t).where(col))
    return t


def _has_window(col: Column) -> bool:
    return "OVER (" in str(col).upper() or "WINDOWSPEC" in str(col).upper()


def _filter_by(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    # a window can't stand in a filter, so it is computed beside the row first
    return df.select("*", values["__keep"].alias("__keep")).where("__keep").drop("__keep")


def filter_by_row(t: Table, test: Callable[[dict], bool]) -> Table:
    """Any Python predicate of a row as a dict, in Arrow batches: the slow path."""
    df = frame(t)
    run = F.udf(lambda row: bool(test(row.asDict() if hasattr(row, "asDict") else dict(row))), "boolean", useArrow=True)
    return rewrap(t, df.where(run(F.struct(*[c(n) for n in df.columns]))))


def filter_not_null(t: Table, *what: str | Selector) -> Table:
    """Rows without missing values in the selected columns (all by default)."""
    df = frame(t)
    names = resolve_names(df, what or [everything()])
    return rewrap(t, df.dropna("any", subset=[quoted(n) for n in names]) if names else df)


def take(t: Table, n: int = 5, order_by: OrderBy = None) -> Table:
    """First rows, of each group if grouped."""
    df, order_by = frame(t), _order(t, order_by)
    _no_stream(df, "take")
    if not keys(t):
        return df.orderBy(*sort_columns(df, order_by)).limit(n)
    w = window(df, keys(t), order_by)
    return rewrap(t, _numbered(df, w).where(F.col("__at") <= n).drop("__at"))


head = take


def take_last(t: Table, n: int = 5, order_by: OrderBy = None) -> Table:
    df, order_by = frame(t), _order(t, order_by)
    _no_stream(df, "take_last")
    back = reversed_columns(df, order_by)
    if not keys(t):
        return df.orderBy(*back).limit(n)
    w = Window.partitionBy(*[c(k) for k in keys(t)]).orderBy(*back)
    return rewrap(t, _numbered(df, w).where(F.col("__at") <= n).drop("__at"))


tail = take_last


def _numbered(df: DataFrame, w) -> DataFrame:
    return df.select("*", F.row_number().over(w).alias("__at"))


def slice_rows(t: Table, *positions: int | range, order_by: OrderBy = None) -> Table:
    """Rows at 1-based positions, of each group if grouped."""
    df, order_by = frame(t), _order(t, order_by)
    _no_stream(df, "slice_rows")
    at = F.col("__at")
    tests = [at.between(p[0], p[-1]) if isinstance(p, range) and p.step == 1 and len(p) else at.isin(list(p) if isinstance(p, range) else [p]) for p in positions]
    keep = reduce(lambda a, b: a | b, tests, F.lit(False))
    most = max([p[-1] if isinstance(p, range) and len(p) else p for p in positions if not isinstance(p, range) or len(p)], default=0)
    if keys(t):
        return rewrap(t, _numbered(df, window(df, keys(t), order_by)).where((at <= most) & keep).drop("__at"))
    return with_index(df, order_by, "__at").where(keep).drop("__at")


def distinct(t: Table, *what: str | Selector, order_by: OrderBy = None) -> Table:
    """First row of each combination of the selected columns, all columns kept. Without an order any
    row of the combination may stay, and no sort is needed."""
    df, order_by = frame(t), _order(t, order_by)
    names = resolve_names(df, what) if what else df.columns
    names = [*(k for k in keys(t) if k not in names), *names]
    if order_by is None and ROW_ID not in df.columns or len(names) == len(df.columns):
        return rewrap(t, df.dropDuplicates(names))
    return rewrap(t, _numbered(df, window(df, names, order_by)).where("__at = 1").drop("__at"))


# ------------------------------------------------------------ order


def sorted_by(t: Table, *by: Any, order_by: OrderBy = None) -> Table:
    """Ascending, nulls last; within groups if grouped. ``desc(...)`` turns a key around. Keys may be
    names, Columns, or deferred expressions. Without keys the frame comes back as it is."""
    df = frame(t)
    if not by:
        return t
    x, terms = _context(t, order_by), []
    for key in by:
        down = isinstance(key, Desc)
        value = key.key if down else key
        if isinstance(value, (Deferred, Column)) or callable(value):
            col = resolve(value, x)
        elif isinstance(value, str):
            if value not in df.columns:
                raise InvalidSortingPredicateError(f"not a column: {value!r}")
            col = c(value)
        else:
            raise InvalidSortingPredicateError(f"a sort key must be a column or an expression: {value!r}")
        terms.append(col.desc_nulls_last() if down else col.asc_nulls_last())
    groups = [c(k).asc_nulls_last() for k in keys(t)]
    if not x.made and not any(_has_window(k) for k in terms):
        return rewrap(t, df.orderBy(*groups, *terms))
    return rewrap(t, x.apply({}, lambda d, _: d.orderBy(*groups, *terms)))


def sorted_by_desc(t: Table, *by: Any) -> Table:
    """Descending, nulls last; every key counts."""
    return sorted_by(t, *[k if isinstance(k, Desc) else desc(k) for k in by])


# ------------------------------------------------------------ sampling

SEED = 3


def sample_n(t: Table, n: int, replace: bool = False, seed: int = SEED) -> Table:
    """Exactly n rows (of each group), in random order. Without replacement there must be as many."""
    if n < 0:
        raise ValueError("n must not be negative")
    return _sample(t, F.lit(n), replace, seed, n)


def sample_frac(t: Table, fraction: float, replace: bool = False, seed: int = SEED) -> Table:
    """A share of the rows (of each group), rounded half up."""
    if fraction < 0 or (fraction > 1 and not replace):
        raise ValueError("the fraction must lie between 0 and 1")
    return _sample(t, F.floor(F.col("__n") * F.lit(float(fraction)) + 0.5), replace, seed, None)


def shuffle(t: Table, seed: int = SEED) -> Table:
    """All rows in random order (within groups)."""
    df = frame(t)
    return rewrap(t, df.orderBy(*[c(k) for k in keys(t)], F.rand(seed)))


def _sample(t: Table, want: Column, replace: bool, seed: int, n: int | None) -> Table:
    df, by = frame(t), list(keys(t))
    if not by and not replace and n is not None:
        have = df.count()
        if n > have:
            raise ValueError(f"{n} rows can't be drawn from {have} without replacement")
        return df.orderBy(F.rand(seed)).limit(n)
    marked = df.withColumn("__r", F.rand(seed))
    if by:
        w = Window.partitionBy(*[c(k) for k in by])
        at = marked.withColumn("__at", F.row_number().over(w.orderBy("__r"))).withColumn("__n", F.count("*").over(w))
    else:
        # positions in random order without a window over everything
        at = with_index(marked, "__r", "__at").withColumn("__n", F.lit(df.count()))
    if not replace:
        enough = F.when(want > F.col("__n"), F.raise_error(F.lit("more rows asked for than there are"))).otherwise(want)
        return rewrap(t, at.where(F.col("__at") <= enough).drop("__r", "__at", "__n"))
    if by:
        sizes = at.groupBy(*[c(k) for k in by]).agg(F.first("__n").alias("__n"))
    else:
        sizes = df.sparkSession.range(1).select(F.lit(df.count()).alias("__n"))
    # each group draws positions of its own; a row is repeated as often as its position is drawn
    drawn = sizes.where("__n > 0").withColumn("__want", want.cast("int")).where("__want > 0")
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(1), F.col("__want"))).alias("__k"))
    drawn = drawn.withColumn("__at", (F.floor(F.rand(seed + 1) * F.col("__n")) + 1).cast(at.schema["__at"].dataType))
    right = drawn.select(*[c(k).alias(f"__key{i}") for i, k in enumerate(by)], F.col("__at").alias("__drawn"))
    on = [c(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(by)] + [F.col("__at") == F.col("__drawn")]
    out = at.join(right, reduce(lambda a, b: a & b, on), "inner")
    return rewrap(t, out.select(*[c(n) for n in df.columns]))


# ------------------------------------------------------------ missing values


def fill(
    t: Table, *what: str | Selector, direction: str = DOWN, value: Any = None, order_by: OrderBy = None
) -> Table:
    """Missing values of the selected columns from neighbouring rows (of the group).

    With a constant ``value`` missing values after the first value seen become that constant (if it is
    of the column's type; otherwise they stay missing). With a frame as ``value`` they come from the
    same position and column of that frame.
    """
    df, order_by = frame(t), _order(t, order_by)
    _no_stream(df, "fill")
    names = resolve_names(df, what) if what else []
    if not names:
        return t
    if isinstance(value, DataFrame):
        at, other = with_index(df, order_by, "__at"), with_index(value, order_by, "__at")
        both = [n for n in names if n in value.columns]
        other = other.select("__at", *[c(n).alias(f"__v_{n}") for n in both])
        out = at.join(other, "__at", "left")
        cols = [F.coalesce(c(n), c(f"__v_{n}")).alias(n) if n in both else c(n) for n in df.columns]
        return rewrap(t, out.select(*cols))
    for n in names:
        seen = filled(n, direction)
        if value is None:
            t = add_column(t, n, seen, order_by)
        else:
            same = _same_type(frame(t).schema[n].dataType, value)
            stand_in = F.lit(value if same else None).cast(frame(t).schema[n].dataType)
            t = add_column(
                t, n, lambda x, n=n, seen=seen, s=stand_in: F.coalesce(x[n], F.when(seen.build(x).isNotNull(), s)), order_by
            )
    return t


def _same_type(kind: DataType, value: Any) -> bool:
    name = kind.typeName()
    if isinstance(value, bool):
        return name == "boolean"
    if isinstance(value, int):
        return name in ("integer", "long", "short", "byte")
    if isinstance(value, float):
        return name in ("double", "float")
    return isinstance(value, str) and isinstance(kind, StringType)

