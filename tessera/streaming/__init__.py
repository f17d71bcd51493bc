"""Summaries of unbounded frames.

Row-local verbs work on streams as they are; verbs that depend on row order refuse them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.deferred import Context, resolve
from ..names import c


def summarize_windows(
    df: DataFrame, time: str, duration: str, *by: str, slide: str | None = None, late: str = "0 seconds", **formulas: Any
) -> DataFrame:
    """Summaries by time window (and keys), for events at most ``late`` behind; state is dropped after."""
    x = Context(df, by, summary=True)
    span = F.window(c(time), duration, slide) if slide else F.window(c(time), duration)
    marked = df.withWatermark(time, late) if df.isStreaming else df
    out = marked.groupBy(span.alias("w"), *[c(k) for k in by]).agg(*[resolve(v, x).alias(n) for n, v in formulas.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c(k) for k in by], *[c(n) for n in formulas])


def summarize_sessions(df: DataFrame, time: str, gap: str, *by: str, late: str = "0 seconds", **formulas: Any) -> DataFrame:
    """Summaries by session: events of a key that follow each other within the gap."""
    x = Context(df, by, summary=True)
    marked = df.withWatermark(time, late) if df.isStreaming else df
    span = F.session_window(c(time), gap)
    out = marked.groupBy(span.alias("w"), *[c(k) for k in by]).agg(*[resolve(v, x).alias(n) for n, v in formulas.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c(k) for k in by], *[c(n) for n in formulas])
