"""Equi-joins in which missing keys match missing keys.

The result has the keys first (in the given order), then the left frame's other columns, then the
right's. Other names that both frames have get suffixes. The strategy is Spark's own choice: null-safe
equality is still an equi-join, so it is planned as a sort-merge, shuffled-hash or broadcast join by
size, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grouped import Table
from ..names import c, check_known, check_unique
from .grouping import ungroup

Keys = "str | Iterable[str | tuple[str, str]] | None"
SUFFIXES = (".x", ".y")


def _pairs(left: DataFrame, right: DataFrame, by) -> list[tuple[str, str]]:
    """(left name, right name) of each key; by default all common names."""
    if by is None:
        return [(n, n) for n in left.columns if n in right.columns]
    if isinstance(by, str):
        by = [by]
    if isinstance(by, dict):
        by = by.items()
    out = [(k, k) if isinstance(k, str) else tuple(k) for k in by]
    check_known(left, [a for a, _ in out])
    check_known(right, [b for _, b in out])
    return out


def _joined(left: Table, right: Table, by, suffixes: tuple[str, str], how: str) -> DataFrame:
    left, right = ungroup(left), ungroup(right)
    pairs = _pairs(left, right, by)
    lk, rk = [a for a, _ in pairs], [b for _, b in pairs]
    lo, ro = [n for n in left.columns if n not in lk], [n for n in right.columns if n not in rk]
    clash = set(lo) & set(ro)
    ln = [n + suffixes[0] if n in clash else n for n in lo]
    rn = [n + suffixes[1] if n in clash else n for n in ro]
    check_unique([*lk, *ln, *rn])
    l_ = left.select(*[c(n).alias(f"l{i}") for i, n in enumerate([*lk, *lo])])
    r_ = right.select(*[c(n).alias(f"r{i}") for i, n in enumerate([*rk, *ro])])
    k = len(pairs)
    if not pairs:
        return _without_keys(l_, r_, ln, rn, how)
    on = reduce(lambda a, b: a & b, [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(k)])
    out = l_.join(r_, on, how)

    def key(i: int) -> Column:
        if how == "right":
            return F.col(f"r{i}")
        # a right-only row of an outer join has its key on the right
        return F.coalesce(f"l{i}", f"r{i}") if how == "full_outer" else F.col(f"l{i}")

    return out.select(
        *[key(i).alias(n) for i, n in enumerate(lk)],
        *[F.col(f"l{k + i}").alias(n) for i, n in enumerate(ln)],
        *[F.col(f"r{k + i}").alias(n) for i, n in enumerate(rn)],
    )


def _without_keys(l_: DataFrame, r_: DataFrame, ln: list[str], rn: list[str], how: str) -> DataFrame:
    """No keys: nothing matches. An outer join has the rows of both sides, an inner one none."""
    l_, r_ = l_.toDF(*ln), r_.toDF(*rn)
    wide = [F.lit(None).cast(f.dataType).alias(f.name) for f in r_.schema.fields]
    left = l_.select("*", *wide)
    right = r_.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in l_.schema.fields], *[c(n) for n in rn])
    none = F.lit(False)
    return {
        "inner": left.where(none),
        "left": left,
        "right": right,
        "full_outer": left.unionByName(right),
    }[how]


def inner_join(left: Table, right: Table, by=None, suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    """``by``: names, or (left, right) pairs of names."""
    return _joined(left, right, by, suffixes, "inner")


def left_join(left: Table, right: Table, by=None, suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    return _joined(left, right, by, suffixes, "left")


def right_join(left: Table, right: Table, by=None, suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    return _joined(left, right, by, suffixes, "right")


def outer_join(left: Table, right: Table, by=None, suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    return _joined(left, right, by, suffixes, "full_outer")


def _half(left: Table, right: Table, by, how: str) -> DataFrame:
    left, right = ungroup(left), ungroup(right)
    pairs = _pairs(left, right, by)
    keys_ = right.select(*[c(b).alias(f"__r{i}") for i, (_, b) in enumerate(pairs)])
    lk = [a for a, _ in pairs]
    shown = [c(n) for n in [*lk, *(n for n in left.columns if n not in lk)]]
    if not pairs:
        return left.where(F.lit(how == "left_anti"))
    on = reduce(lambda a, b: a & b, [c(a).eqNullSafe(F.col(f"__r{i}")) for i, a in enumerate(lk)])
    return left.join(keys_, on, how).select(*shown)


def semi_join(left: Table, right: Table, by=None) -> DataFrame:
    """Left rows that have a match; the keys come first."""
    return _half(left, right, by, "left_semi")


def anti_join(left: Table, right: Table, by=None) -> DataFrame:
    """Left rows that have none (more than the verbs' grammar asks for)."""
    return _half(left, right, by, "left_anti")


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; names that clash get _1, _2, ... The result has as many rows as the product
    of both, so one side must be small; Spark's own size check decides whether it is broadcast."""
    from ..names import without_clashes

    names = [*left.columns, *without_clashes(left.columns, right.columns)]
    return left.toDF(*[f"l{i}" for i in range(len(left.columns))]).crossJoin(
        right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    ).toDF(*names)
