"""Sample tables made by rule, for examples and tests: the shapes of well-known data sets, invented values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int) -> Column:
    """A repeatable number in [0, 1) from the row's id."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)).cast("double") / 1_000_003


def _normal(seed: int, mean: Column | float, spread: float) -> Column:
    twelve = sum((_uniform(seed + k) for k in range(12)), F.lit(-6.0))
    return F.round(F.lit(mean) + twelve * spread if not isinstance(mean, Column) else mean + twelve * spread, 1)


def flowers(spark: SparkSession) -> DataFrame:
    """150 rows: four measures and three species of 50."""
    kind = (F.col("id") / 50).cast("int")
    by_kind = lambda *m: F.element_at(F.array(*map(F.lit, m)), kind + 1)
    return spark.range(150).select(
        _normal(1, by_kind(5.0, 5.9, 6.6), 0.4).alias("Sepal.Length"),
        _normal(20, by_kind(3.4, 2.8, 3.0), 0.3).alias("Sepal.Width"),
        _normal(40, by_kind(1.5, 4.3, 5.6), 0.3).alias("Petal.Length"),
        _normal(60, by_kind(0.2, 1.3, 2.0), 0.2).alias("Petal.Width"),
        by_kind("setosa", "versicolor", "virginica").alias("Species"),
    )


def sleep(spark: SparkSession) -> DataFrame:
    """83 rows of animals with missing values in five columns."""
    gone = lambda seed, share, v: F.when(_uniform(seed) >= share, v)
    total = F.round(2 + 18 * _uniform(3), 1)
    pick = lambda seed, *names: F.element_at(F.array(*map(F.lit, names)), (_uniform(seed) * len(names)).cast("int") + 1)
    return spark.range(83).select(
        F.format_string("Animal %d", "id").alias("name"),
        F.format_string("Genus%d", (F.col("id") % 77)).alias("genus"),
        gone(5, 0.08, pick(6, "carni", "herbi", "insecti", "omni")).alias("vore"),
        pick(7, "Carnivora", "Rodentia", "Primates", "Artiodactyla", "Soricomorpha").alias("order"),
        gone(8, 0.35, pick(9, "lc", "vu", "en", "domesticated")).alias("conservation"),
        total.alias("sleep_total"),
        gone(10, 0.27, F.round(total * 0.2, 1)).alias("sleep_rem"),
        gone(11, 0.6, F.round(0.1 + _uniform(12), 2)).alias("sleep_cycle"),
        F.round(24 - total, 1).alias("awake"),
        gone(13, 0.33, F.round(0.001 + _uniform(14), 4)).alias("brainwt"),
        F.round(0.01 + 500 * F.pow(_uniform(15), F.lit(6)), 3).alias("bodywt"),
    )


def flights(spark: SparkSession, n: int = 336_776) -> DataFrame:
    """Departures of a year, with missing delays."""
    day = F.expr("date_add(date'2013-01-01', cast(id % 365 as int))")
    pick = lambda seed, *names: F.element_at(F.array(*map(F.lit, names)), (_uniform(seed) * len(names)).cast("int") + 1)
    flown = _uniform(2) >= 0.025
    delay = F.floor(F.pow(_uniform(3), F.lit(8)) * 600 - 10).cast("int")
    hour = (5 + F.floor(_uniform(4) * 18)).cast("int")
    minute = F.floor(_uniform(5) * 60).cast("int")
    return spark.range(n).select(
        F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        F.when(flown, hour * 100 + minute).alias("dep_time"), F.when(flown, delay).alias("dep_delay"),
        F.when(flown, ((hour + 2) % 24) * 100 + minute).alias("arr_time"), F.when(flown, delay + F.floor(_uniform(6) * 30).cast("int") - 15).alias("arr_delay"),
        pick(7, "UA", "AA", "DL", "B6", "EV", "WN").alias("carrier"), F.when(_uniform(8) >= 0.007, F.format_string("N%05d", F.col("id") % 4043)).alias("tailnum"),
        (F.col("id") % 8500).cast("int").alias("flight"), pick(9, "EWR", "JFK", "LGA").alias("origin"), pick(10, "ATL", "LAX", "ORD", "MCO", "BOS").alias("dest"),
        F.when(flown, (30 + _uniform(11) * 300).cast("int")).alias("air_time"), (100 + _uniform(12) * 2400).cast("int").alias("distance"),
        F.when(flown, hour).alias("hour"), F.when(flown, minute).alias("minute"),
    )
