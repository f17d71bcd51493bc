"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: x20 and x09 to x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def crc_mod5(col: Column) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(5)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written tables under the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self.n, self.held = 0, []

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        self.held.append(out)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables written so far but these, when nothing that is still to be read is made from them."""
        for df in self.held:
            if not any(df is t for t in tables):
                self.drop(df)
        self.held = list(tables)

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_tessera_path", None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession, records: int = 4000, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and bytes, so that long texts don't pile up in a worker.

    Spark reads these settings when a plan runs, which is after the operator has returned, so they stay
    set in the session; tighter ones that are set already are left alone."""
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key).removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def text_groups(batches, column: int, size: int = 4 << 20):
    """Slices of whole rows with about ``size`` bytes in the column of texts, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def join_back(rows: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join what a grouping by ``keys`` has found to the rows. A hash beside the keys gives both sides
    an exchange of their own; without it the grouping's exchange is used again, and adaptive execution
    does not split a hot key there."""
    rows, found = (x.withColumn("_h", F.xxhash64(*keys)) for x in (rows, found))
    return rows.join(found, ["_h", *keys], how).drop("_h")


def bounded_sample(df: DataFrame, key: Column, n: int, seed: int, total: int) -> DataFrame:
    """At most n rows (with a column ``text``) in the order of a hash of the key and the text.

    Rows whose hash is too high to be among the first are dropped where they are read, so that a few
    times n rows are all that meets in one task, however many partitions there are. ``total``: rows of
    the whole table, which files say without being read. Texts under one key have hashes of their own,
    so a key that all rows share (or none has) takes neither all of them nor none.
    """
    order = F.xxhash64(key.cast("string"), F.col("text"), F.lit(seed))
    if total > 8 * n:
        df = df.where(order <= F.lit(int(-(2**63) + 2**64 * (4 * n / total))))
    return df.orderBy(order, "text").limit(n)
