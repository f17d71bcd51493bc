"""Windows and sessions over streams give the same rows as over tables."""

from pyspark.sql import functions as F

from tessera.functions import aggs as A
from tessera.functions import exprs as X
from tessera.operators import verbs as V
from tessera.streaming import summarize_sessions, summarize_windows


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_streams_against_tables(spark, tmp_path):
    made = spark.range(200).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 + F.when(F.col("id") > 120, 4000).otherwise(0)).alias("ts"),
        (F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("v"),
    )
    made.repartition(2).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))

    def both(name, plan):
        query = plan(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert _rows(spark.table(name)) == _rows(plan(table)) and spark.table(name).count() > 2

    kept = lambda df: V.filter_rows(df, X.ge("v", 10))
    both("windows_out", lambda df: summarize_windows(kept(df), "ts", "10 minutes", "k", late="1 hour", n=A.n(), m=A.mean("v", remove_na=True)))
    both("sessions_out", lambda df: summarize_sessions(kept(df), "ts", "5 minutes", "k", late="1 hour", n=A.n()))
