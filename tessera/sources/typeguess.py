"""Column types of text data: given, or guessed from the first values.

A guess looks at the first ``GUESS`` values that aren't missing: boolean (T, F, TRUE, FALSE in any case), int,
long, double, else text. A later value that doesn't fit an integer guess makes the column text; one
that doesn't fit a double is an error when read. Blank cells of numeric columns are missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import ROW_ID, c

GUESS = 100
GUESSED = "guess"
TYPES = ("boolean", "int", "long", "double", "string")
#: Letters of a compact specification, fixed.
LETTERS = {"s": "string", "i": "int", "l": "long", "d": "double", "b": "boolean", "?": GUESSED, "D": "date", "T": "timestamp_ntz"}

_INT = r"^[+-]?\d+$"
_DOUBLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity)$"
_BOOL = r"(?i)^(T|F|TRUE|FALSE)$"


class ColumnTypes:
    """Types by name; ``default`` covers the rest."""

    def __init__(self, types: dict[str, str] | None = None, default: str = GUESSED):
        self.types = {k: v for k, v in (types or {}).items() if k != ".default"}
        self.default = (types or {}).get(".default", default)

    def of(self, names: Iterable[str]) -> dict[str, str]:
        return {n: self.types.get(n, self.default) for n in names}


class Compact(ColumnTypes):
    """One letter for each column: ``s i l d b ?``, and ``D T`` for dates and times."""

    def __init__(self, letters: str):
        super().__init__()
        unknown = set(letters) - set(LETTERS)
        if unknown:
            raise ValueError(f"unknown type letters: {sorted(unknown)}")
        self.letters = letters

    def of(self, names: Iterable[str]) -> dict[str, str]:
        names = list(names)
        if len(names) != len(self.letters):
            raise ValueError(f"{len(self.letters)} letters for {len(names)} columns")
        return {n: LETTERS[x] for n, x in zip(names, self.letters, strict=True)}


def _fits(col: Column, kind: str) -> Column:
    text = col
    if kind == "boolean":
        return text.rlike(_BOOL)
    if kind == "int":
        return text.rlike(_INT) & text.try_cast("int").isNotNull()
    if kind == "long":
        return text.rlike(_INT) & text.try_cast("bigint").isNotNull()
    if kind == "double":
        return text.rlike(_DOUBLE)
    return F.lit(True)


def typed(col: Column, kind: str) -> Column:
    """Text as a value of the type; what doesn't fit raises an error (double) or is missing."""
    filled = F.when(F.trim(col) != "", col)
    if kind == "boolean":
        up = F.upper(filled)
        return F.when(up.isin("T", "TRUE"), F.lit(True)).when(up.isin("F", "FALSE"), F.lit(False))
    if kind == "int":
        return filled.try_cast("int")
    if kind in ("long", "bigint"):
        return filled.try_cast("bigint")
    if kind == "string":
        return col
    return filled.cast(kind)


def guess_types(df: DataFrame, names: Iterable[str], guess: int = GUESS) -> dict[str, str]:
    """Guesses for text columns, all from the first ``10 * guess`` rows: one job reads these, and one
    aggregate over all rows holds integer guesses against every value. That aggregate also judges, by
    all its values, a column of which the first rows have fewer than ``guess``."""
    names = list(names)
    if not names:
        return {}
    text = [c(n) for n in names]
    present = [v.isNotNull() & (F.trim(v) != "") for v in text]
    first = df.select(*text).toDF(*[f"v{i}" for i in range(len(names))]).limit(10 * guess)
    # a limit is one partition, in the order of the files
    some = first.agg(*[
        F.slice(F.collect_list(F.when(F.trim(f"v{i}") != "", F.col(f"v{i}"))), 1, guess).alias(f"v{i}") for i in range(len(names))
    ])
    every = lambda v, k: F.forall(v, lambda x: _fits(x, k))
    row = some.select(
        *[F.size(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[every(F.col(f"v{i}"), k).alias(f"{k}{i}") for i in range(len(names)) for k in TYPES[:-1]],
    ).first()
    out = {n: next((k for k in TYPES[:-1] if row[f"n{i}"] and row[f"{k}{i}"]), "string") for i, n in enumerate(names)}
    few = [i for i in range(len(names)) if row[f"n{i}"] < guess]
    whole = [i for i, n in enumerate(names) if i not in few and out[n] in ("int", "long")]
    checks = [F.count_if(present[i] & ~_fits(text[i], out[names[i]])).alias(f"b{i}") for i in whole]
    checks += [F.bool_and(F.when(present[i], _fits(text[i], k))).alias(f"{k}{i}") for i in few for k in TYPES[:-1]]
    if checks:
        found = df.agg(*checks).first()
        out |= {names[i]: "string" for i in whole if found[f"b{i}"]}
        out |= {names[i]: next((k for k in TYPES[:-1] if found[f"{k}{i}"]), "string") for i in few}
    return out


def apply_types(df: DataFrame, types: ColumnTypes | dict | str | None = None, names: Iterable[str] | None = None, guess: int = GUESS) -> DataFrame:
    """Text columns to the types asked for, or guessed."""
    if types is None:
        types = ColumnTypes()
    elif isinstance(types, str):
        types = Compact(types)
    elif isinstance(types, dict):
        types = ColumnTypes(types)
    names = [n for n in (names or df.columns) if n != ROW_ID]
    wanted = types.of(names)
    guessed = guess_types(df, [n for n, k in wanted.items() if k == GUESSED], guess)
    kinds = {n: guessed.get(n, k) for n, k in wanted.items()}
    return df.select(*[typed(c(n), kinds[n]).alias(n) if n in kinds else c(n) for n in df.columns])


def convert_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text columns among the names typed anew, by a guess."""
    text = [n for n in names if df.schema[n].dataType.typeName() == "string"]
    return apply_types(df, names=text) if text else df
