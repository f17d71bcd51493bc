"""Whole-frame order: ranges of all keys, at any number of partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tessera as t
from tessera.order import Ranges, desc, with_index


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 7, 1000, 4000])
def test_many_partitions(spark, partitions, n):
    partitions(n)
    df = spark.range(3000).select("id", F.lit("same").alias("flag"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("v"))
    assert with_index(df, ["flag", "id"]).where("__index <> id + 1").count() == 0
    got = t.add_columns(df, s=t.cum_sum(F.col("id")), b=t.lag("id"), f=t.filled("v"), order_by=["flag", "id"])
    assert got.where("s <> id * (id + 1) / 2 or coalesce(b, -1) <> id - 1").count() == 0
    assert got.where("f is null").count() == 1 and got.where("id % 5 = 0 and id > 0 and f <> (id - 1) % 3").count() == 0


@pytest.mark.parametrize("order", [["flag", "id"], ["flag"], ["day", "flag"], [desc("flag"), desc("id")], [desc("text")], ["at", "id"], ["nothing", "id"]])
def test_ranges_hold_their_share(spark, partitions, order):
    partitions(16)
    df = spark.range(8000).select(
        "id", F.lit(True).alias("flag"), F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("day"), F.lit(None).cast("string").alias("nothing"),
        F.concat(F.lit("t"), F.col("id") % 4).alias("text"), F.timestamp_seconds(F.col("id") % 2).alias("at"), F.create_map("id", F.lit(1)).alias("m"),
    )
    r = Ranges(df, order)
    sizes = [x["count"] for x in r.df.groupBy(r.name).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3 * 8000 / 16


def test_positions_against_a_sort(spark, partitions):
    partitions(9)
    rng = random.Random(4)
    day, some = dt.date(2024, 3, 1), lambda f: None if rng.random() < 0.1 else f()
    rows = [
        (i, some(lambda: rng.choice("abÄ")), some(lambda: rng.choice([0.5, -1.0, float("nan"), float("inf")])), some(lambda: day + dt.timedelta(rng.randrange(4))),
         some(lambda: dt.datetime(2024, 1, 1, rng.randrange(4)))) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id long, a string, x double, d date, at timestamp").repartition(5)
    nan = lambda x: (x != x, 0 if x != x else x)
    last = lambda v, f=lambda v: v: (v is None, () if v is None else f(v))
    want = sorted(rows, key=lambda r: (last(r[1], lambda s: s.encode()), last(r[2], nan), last(r[3]), r[0]))
    got = {r["id"]: r["__index"] for r in with_index(df, ["a", "x", "d", "id"]).collect()}
    assert [got[r[0]] for r in want] == list(range(1, 601))
    down = sorted(rows, key=lambda r: (r[4] is None, -(r[4] - dt.datetime(2024, 1, 1)).seconds if r[4] else 0, r[0]))
    got = {r["id"]: r["__index"] for r in with_index(df, [desc("at"), "id"]).collect()}
    assert [got[r[0]] for r in down] == list(range(1, 601))
