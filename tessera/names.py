"""Column names: quoting, clashes, suffixes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import DuplicatedColumnNameError, UnknownColumnError

#: Row number column that readers and builders add on request.
ROW_ID = "__rid"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """The column of that name, dots, spaces and brackets included."""
    return F.col(quoted(name))


def check_unique(names: Iterable[str]) -> list[str]:
    names = list(names)
    if len(set(names)) != len(names):
        raise DuplicatedColumnNameError(names)
    return names


def check_known(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise UnknownColumnError(f"unknown columns {missing}; there are {df.columns}")
    return names


def fresh(df: DataFrame, base: str) -> str:
    """A name that the frame doesn't have."""
    name, n = base, 0
    while name in df.columns:
        n += 1
        name = f"{base}_{n}"
    return name


def without_clashes(taken: Iterable[str], names: Iterable[str]) -> list[str]:
    """``names``, those that are taken with _1, _2, ... behind them."""
    taken, out = set(taken), []
    for name in names:
        new, n = name, 0
        while new in taken:
            n += 1
            new = f"{name}_{n}"
        out.append(new)
        taken.add(new)
    return out


def numbered_duplicates(names: Iterable[str]) -> list[str]:
    """Repeated header names get _2, _3, ... from the second on."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        new = name if seen[name] == 1 else f"{name}_{seen[name]}"
        while new in out:
            seen[name] += 1
            new = f"{name}_{seen[name]}"
        out.append(new)
    return out


def valid_identifier(name: str) -> str:
    """A camel-case identifier made of a column name."""
    parts = [p for p in re.split(r"[^0-9A-Za-z_]+", name) if p]
    if not parts:
        return "_"
    out = parts[0][0].lower() + parts[0][1:] + "".join(p[0].upper() + p[1:] for p in parts[1:])
    return "_" + out if out[0].isdigit() else out
