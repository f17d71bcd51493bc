"""Frames as text and HTML: the first rows, the schema, column types."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import Table, frame
from .names import c

_LABELS = {"integer": "Int", "long": "Long", "double": "Dbl", "float": "Dbl", "boolean": "Bol", "string": "Str", "array": "List", "struct": "Record"}


def type_label(kind) -> str:
    return _LABELS.get(kind.typeName(), kind.typeName().capitalize())


def _cell(v: Any, digits: int) -> str:
    if v is None:
        return "<NA>"
    if isinstance(v, float):
        if v != v or abs(v) == float("inf"):
            return str(v)
        text = f"{v:.{digits}f}".rstrip("0").rstrip(".")
        return "0" if text in ("-0", "") else text
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def as_string(
    t: Table, title: str = "A data frame", *, names: bool = True, rows: int = 10, width: int = 100, digits: int = 3, row_numbers: bool = True
) -> str:
    """The first rows, as many columns as fit, and what was left out. Counts the rows (a job)."""
    df = frame(t)
    n, shown = df.count(), df.limit(rows).collect()
    columns = [[name] * names + [_cell(r[i], digits) for r in shown] for i, name in enumerate(df.columns)]
    if row_numbers:
        columns.insert(0, [""] * names + [str(i) for i in range(1, len(shown) + 1)])
    used, fit = 0, 0
    for col in columns:
        used += max(map(len, col), default=0) + 3
        if used > width and fit:
            break
        fit += 1
    wide = [max(map(len, col), default=0) for col in columns[:fit]]
    lines = [f"{title}: {n} x {len(df.columns)}"]
    for i in range(len(shown) + names):
        lines.append("   ".join(col[i].rjust(w) for col, w in zip(columns[:fit], wide, strict=True)).rstrip())
    more = []
    if n > len(shown):
        more.append(f"{n - len(shown)} more rows")
    left = df.columns[fit - row_numbers :]
    if left:
        more.append(f"{len(left)} more variables: {', '.join(left)}")
    if more:
        lines.append("and " + ", and ".join(more))
    return "\n".join(lines)


def show(t: Table, **options) -> None:
    print(as_string(t, **options))


def schema_string(t: Table, digits: int = 3, width: int = 80) -> str:
    """Name, type and first values of every column."""
    df = frame(t)
    rows = df.limit(255).collect()
    pad, kinds = max(map(len, df.columns), default=0), [type_label(f.dataType) for f in df.schema.fields]
    lines = [f"DataFrame with {df.count()} observations"]
    for i, (name, kind) in enumerate(zip(df.columns, kinds, strict=True)):
        line = f"{name.ljust(pad)}  [{kind}]  " + ", ".join(_cell(r[i], digits) for r in rows)
        lines.append(line if len(line) <= width else line[: width - 4].rstrip(", ") + ", ...")
    return "\n".join(lines)


def column_types(t: Table) -> DataFrame:
    """(index, name, type) of every column as a frame."""
    df = frame(t)
    rows = [(i, f.name, type_label(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "index int, name string, type string")


def to_html(t: Table, title: str | None = None, rows: int = 20, truncate: int = 50) -> str:
    df = frame(t)
    n, shown = df.count(), df.limit(rows).collect()

    def cell(v: Any) -> str:
        text = _cell(v, 6)
        short = text if len(text) <= truncate else text[: truncate - 3] + "..."
        return f"<td title=\"{html.escape(text)}\">{html.escape(short)}</td>"

    head = "".join(f"<th style=\"text-align:left\">{html.escape(c_)}</th>" for c_ in df.columns)
    body = "".join(f"<tr>{''.join(cell(v) for v in r)}</tr>" for r in shown)
    more = f"<p>... with {n - len(shown)} more rows.</p>" if n > len(shown) else ""
    top = f"<h3>{html.escape(title)}</h3>" if title else ""
    return f"<html><body>{top}<table><tr>{head}</tr>{body}</table>{more}<p>Shape: {n} x {len(df.columns)}.</p></body></html>"


def shape(t: Table) -> tuple[int, int]:
    return frame(t).count(), len(frame(t).columns)


def equal(a: DataFrame, b: DataFrame, *, ordered: bool = False) -> bool:
    """Equal columns, types and rows; in any order unless ``ordered``. Rows are counted where they lie:
    each side's surplus of every row must be empty."""
    if [(f.name, f.dataType) for f in a.schema.fields] != [(f.name, f.dataType) for f in b.schema.fields]:
        return False
    if ordered:
        return a.collect() == b.collect()
    names = [c(n) for n in a.columns]
    both = a.select(*names, F.lit(1).alias("__n")).unionAll(b.select(*names, F.lit(-1).alias("__n")))
    return both.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()
