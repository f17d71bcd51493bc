"""A frame with grouping keys. Groups are never split physically: summaries become aggregates, all else
becomes windows partitioned by the keys."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

Order = tuple["str | Column", ...]


@dataclass(frozen=True)
class Grouped:
    """``by`` are the key columns; null is a key like any other."""

    df: DataFrame
    by: tuple[str, ...]
    order_by: Order = ()

    def with_df(self, df: DataFrame) -> Grouped:
        return replace(self, df=df)

    @property
    def columns(self) -> list[str]:
        return self.df.columns


Table = DataFrame | Grouped


def frame(t: Table) -> DataFrame:
    return t.df if isinstance(t, Grouped) else t


def keys(t: Table) -> tuple[str, ...]:
    return t.by if isinstance(t, Grouped) else ()


def rewrap(t: Table, df: DataFrame) -> Table:
    return t.with_df(df) if isinstance(t, Grouped) else df
