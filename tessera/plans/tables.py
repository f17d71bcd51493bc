"""The sample tables of a folder, and the register of queries over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def holes(self) -> DataFrame:
        """Events with missing values: every seventh value and every eleventh user."""
        e = self.events
        return e.select(
            "event_id",
            F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"),
            "event_type",
            F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        )


_HOLES = """(SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""
_W = "(PARTITION BY user_id ORDER BY event_id)"


def query(sql: str | None):
    """Registers a function of the tables under its own name, with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
