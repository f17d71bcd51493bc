"""Tables of databases. Spark pushes filters and columns down to the database and, given a number
column with bounds, reads it in parallel."""

from __future__ import annotations

import decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

from ..names import c
from .builders import from_columns


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    driver: str | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table or query. ``partition``: column, lower bound, upper bound, number of parts."""
    options = {"url": url, "dbtable": f"({query}) q" if " " in query.strip() else query, **(properties or {})}
    if driver:
        options["driver"] = driver
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
    return plain_numbers(spark.read.format("jdbc").options(**options).load())


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[c(n).cast("double").alias(n) if isinstance(k, DecimalType) else c(n) for n, k in kinds.items()])


def from_cursor(spark: SparkSession, cursor) -> DataFrame:
    """What a DB-API cursor still has to give, missing values as such. A literal, built on the driver."""
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return from_columns(spark, {n: [plain(r[i]) for r in rows] for i, n in enumerate(names)})
