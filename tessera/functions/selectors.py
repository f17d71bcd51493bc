"""Column selectors. Each gives every column one of three opinions: keep, drop, or none.

Opinions of several selectors are joined: no opinion yields to the other, keep and keep is keep, all
else is drop; so two positive selectors select the union. A result that both keeps and drops is an
error. One that keeps something, or says nothing at all, keeps just what it names; a negative one drops
what it names (and keeps everything when it names nothing).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField

from ..errors import InvalidColumnSelectError
from ..names import check_known, check_unique

Opinion = bool | None


class Selector:
    def __init__(self, opinions: Callable[[list[StructField]], list[Opinion]], *, negative: bool = False):
        self.opinions = opinions
        self.negative = negative

    def __and__(self, other: Selector) -> Selector:
        return Selector(
            lambda f: [join(a, b) for a, b in zip(self.opinions(f), other.opinions(f), strict=True)],
            negative=self.negative and other.negative,
        )

    def __invert__(self) -> Selector:
        return Selector(lambda f: [None if o is None else not o for o in self.opinions(f)], negative=not self.negative)


def join(a: Opinion, b: Opinion) -> Opinion:
    if a is None:
        return b
    if b is None:
        return a
    return a and b


def _positive(test: Callable[[StructField], bool]) -> Selector:
    return Selector(lambda fields: [True if test(f) else None for f in fields])


def matches(pattern: str) -> Selector:
    """Names that the regular expression matches as a whole."""
    return _positive(lambda f: re.fullmatch(pattern, f.name) is not None)


def starts_with(prefix: str) -> Selector:
    return _positive(lambda f: f.name.startswith(prefix))


def ends_with(suffix: str) -> Selector:
    return _positive(lambda f: f.name.endswith(suffix))


def one_of(*names: str) -> Selector:
    return _positive(lambda f: f.name in names)


def everything() -> Selector:
    return _positive(lambda f: True)


def col_range(first: str, last: str) -> Selector:
    """From one column to another, both included."""

    def opinions(fields: list[StructField]) -> list[Opinion]:
        names = [f.name for f in fields]
        missing = [n for n in (first, last) if n not in names]
        if missing:
            raise InvalidColumnSelectError(f"unknown columns {missing} in a range")
        a, b = sorted((names.index(first), names.index(last)))
        return [True if a <= i <= b else None for i in range(len(names))]

    return Selector(opinions)


def except_(*what: str | Selector) -> Selector:
    """All but these."""
    out: Selector | None = None
    names = [w for w in what if isinstance(w, str)]
    for s in [*([one_of(*names)] if names else []), *(w for w in what if isinstance(w, Selector))]:
        out = ~s if out is None else out & ~s
    return out if out is not None else Selector(lambda f: [None] * len(f), negative=True)


def by_type(*types: type[DataType]) -> Selector:
    return _positive(lambda f: isinstance(f.dataType, types))


def where_(test: Callable[[StructField], bool]) -> Selector:
    return _positive(test)


def resolve_names(df: DataFrame, what: Iterable[str | Selector]) -> list[str]:
    """Selected names: plain names in the given order, or what the joined selectors keep."""
    what = list(what)
    if all(isinstance(w, str) for w in what):
        return check_unique(check_known(df, what))
    selectors = [one_of(w) if isinstance(w, str) else w for w in what]
    both = selectors[0]
    for s in selectors[1:]:
        both = both & s
    fields = df.schema.fields
    opinions = both.opinions(fields)
    if True in opinions and False in opinions:
        said = ", ".join(("<null>" if o is None else ("+" if o else "-") + f.name) for f, o in zip(fields, opinions, strict=True))
        raise InvalidColumnSelectError(f"positive and negative selections are mixed: {said}")
    if False in opinions or (True not in opinions and both.negative):
        return [f.name for f, o in zip(fields, opinions, strict=True) if o is None]
    return [f.name for f, o in zip(fields, opinions, strict=True) if o]
