"""Exact deduplication by deterministic block naming. DataFrame operations only.

The UTF-8 bytes of the normalised text are cut into blocks of a fixed size. Equal blocks are brought
together by a grouping on the block itself and get one integer name, from the least occurrence number
in their group. Adjacent names are then paired, and pairs are named the same way, level after level,
until every document has a single integer. No hash decides anything, so names are free of collisions:
two documents end with the same integer on the same level exactly when their texts are equal.

Scale: a level groups with map-side combining (a block that a third of all rows share is one row per
task before the shuffle). Only names that occur twice or more are joined back, by a plain equi-join
that adaptive execution splits where a key is hot; a name that occurs once is its own. A level has
half the rows of the one before, and levels grow with the logarithm of the longest text. Every level
is written to the shared folder, so a lost executor costs one level at most.

Defined results: null counts as empty; the empty text is one block. Equal texts form a group whatever
their other columns hold; repeated rows of one id are members each. The least id stays (null ids are
least of all only when every id of the group is null); of several rows with that id one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import SPACE_RUN, Scratch, join_back, table, text_of

#: Bytes of a block.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with name: from the least occurrence number among the rows whose keys are equal.

    Joined names are odd and a row's own are even, so they can't meet even where the two sides of the
    join number their rows differently (an input in no fixed order).
    """
    names = rows.groupBy(*keys).agg(F.min("occ").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = join_back(rows, names, keys, "left")
    name = F.when(F.col("least").isNotNull(), F.col("least") * 2 + 1).otherwise(F.col("occ") * 2)
    return out.withColumn("name", name).drop("least", *keys)


def block_names(df: DataFrame, text: Column, keep: dict[str, Column], *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns, ``level`` and ``identity``: a pair of integers equal for equal texts only."""
    scratch = Scratch(df.sparkSession, "naming")
    base = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[c.alias(k) for k, c in keep.items()]).alias("own"),
        text.cast("binary").alias("t"),
    )
    last = F.floor((F.greatest(F.octet_length("t"), F.lit(1)) - 1) / F.lit(block_bytes)).cast("int")
    blocks = (
        base.withColumn("last", last)
        .select("row", "own", "last", "t", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
        .select(
            "row",
            "last",
            "i",
            F.when(F.col("i") == 0, F.col("own")).alias("own"),
            F.monotonically_increasing_id().alias("occ"),
            F.substring(F.col("t"), F.col("i") * block_bytes + 1, F.lit(block_bytes)).alias("block"),
        )
    )
    level = scratch.write(_named(blocks, ["block"]))
    done, depth = None, 0
    while True:
        ended = level.where("last = 0").select("own", F.lit(depth).alias("level"), F.col("name").alias("identity"))
        done = ended if done is None else done.unionByName(ended)
        if level.where("last > 0").isEmpty():
            return done.select("own.*", "level", "identity")
        # an odd last name is paired with -1, which is no name
        half = lambda k: F.coalesce(F.min(F.when(F.col("i") % 2 == k, F.col("name"))), F.lit(-1))
        pairs = (
            level.where("last > 0")
            .groupBy("row", F.floor(F.col("i") / 2).cast("int").alias("pair"))
            .agg(
                F.min("occ").alias("occ"),
                F.floor(F.max("last") / 2).cast("int").alias("last"),
                F.first("own", ignorenulls=True).alias("own"),
                half(0).alias("a"),
                half(1).alias("b"),
            )
            .withColumnRenamed("pair", "i")
        )
        level, depth = scratch.write(_named(pairs, ["a", "b"])), depth + 1


def duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256 and the row's number.

    ``row_col`` holds distinct numbers of rows; without it they are made here, and say nothing to
    another job that reads the same input."""
    text = normalised(text_of(df, text_col))
    row_no = F.monotonically_increasing_id() if row_col is None else df[row_col]
    keep = {"doc_id": df[id_col], "row_no": row_no, "text_sha256": F.lower(F.sha2(text, 256))}
    named = block_names(df, text, keep, block_bytes=block_bytes)
    groups = named.groupBy("level", "identity").agg(
        F.count("*").alias("group_size"),
        # nulls last: the least id that there is; rows of that id are told apart by their number
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("least"),
    )
    return join_back(named, groups, ["level", "identity"], "inner").select(
        "doc_id",
        F.col("least.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("least.row_no")).alias("kept"),
        "text_sha256",
        "row_no",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).drop("row_no")


OP7_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
