"""Delimited text. Files are read by Spark's own reader, in parallel; only the header line and the
samples for type guesses come to the driver."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import ROW_ID, c, numbered_duplicates
from .storage import put, readable, shared_path
from .typeguess import GUESS, ColumnTypes, apply_types

NA = "NA"


def _lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Lines in order, without the first ``skip`` of every file; the path may be anything Spark reads,
    compressed or not. Leaving lines out takes a pass through Python in Arrow batches, and no exchange:
    a file's first lines are those that begin at its first byte."""
    lines = spark.read.text(path)
    if skip:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, seen = None, 0
            for batch in batches:
                files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                at = 0
                while at < len(files):
                    here = (files[at], starts[at])
                    to = at + 1
                    while to < len(files) and (files[to], starts[to]) == here:
                        to += 1
                    if here != now:
                        now, seen = here, 0
                    gone = max(0, min(to - at, skip - seen)) if here[1] == 0 else 0
                    seen += to - at
                    if at + gone < to:
                        yield batch.slice(at + gone, to - at - gone).select(["value"])
                    at = to

        lines = lines.mapInArrow(run, "value string")
    return lines.withColumn(ROW_ID, F.monotonically_increasing_id())


def read_delim(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    *,
    header: bool | Iterable[str] = True,
    types: ColumnTypes | dict | str | None = None,
    na: str = NA,
    skip: int = 0,
    guess: int = GUESS,
    quote: str = '"',
    trim: bool = False,
    multiline: bool = False,
    row_id: bool = False,
) -> DataFrame:
    """A delimited file, or files of equal headers. Without a header columns are X1, X2, ...; ``skip``
    lines of each file go first.

    Guessing types reads the file; give ``types`` to avoid that. ``row_id`` keeps the rows' order in a
    column that the order-dependent verbs use.
    """
    path = readable(spark, path)
    names = None if header is True or header is False else list(header)
    options = {"sep": sep, "quote": quote, "nullValue": na, "emptyValue": "", "escape": quote}
    options |= {"ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "multiLine": multiline}
    first = spark.read.text(path).limit(skip + 1).collect()
    line = first[skip]["value"] if len(first) > skip else ""
    cells = next(csv.reader([line], delimiter=sep, quotechar=quote), [])
    if names is None:
        names = numbered_duplicates([x.strip() if trim else x for x in cells]) if header is True else [f"X{i}" for i in range(1, len(cells) + 1)]
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    if skip:
        # lines before the header: the rest is parsed as it would be from a file
        lines = _lines(spark, path, skip + (header is True))
        parsed = lines.select(ROW_ID, F.from_csv("value", schema, {k: str(v) for k, v in options.items() if k != "multiLine"}).alias("r"))
        df = parsed.where("r is not null").select(*[f"r._c{i}" for i in range(len(names))], ROW_ID)
    else:
        df = spark.read.schema(schema).options(header=header is True, **options).csv(path).withColumn(ROW_ID, F.monotonically_increasing_id())
    df = df.toDF(*names, ROW_ID)
    df = apply_types(df, types, names, guess)
    return df if row_id else df.drop(ROW_ID)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delim(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delim(spark, path, "\t", **{"trim": True, **options})


def read_stream(spark: SparkSession, stream: io.IOBase | bytes, sep: str = ",", **options) -> DataFrame:
    """An open binary stream (plain, gzip or zip by its first bytes), or a text stream. Its content goes
    to the shared folder, where executors read it."""
    path = put(spark, stream, shared_path(spark, "stream.zip"))  # unpacked by what its first bytes say
    return read_delim(spark, path, sep, **options)


def write_delim(df: DataFrame, path: str, sep: str = ",", *, header: bool = True, na: str = "", single_file: bool = False, mode: str = "errorifexists") -> None:
    """Delimited text; a path that ends in .gz is compressed. ``single_file`` writes one part."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).option("header", header).option("sep", sep).option("nullValue", na).option("emptyValue", "").option("escape", '"')
    if path.endswith((".gz", ".zip")):
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_csv(df: DataFrame, path: str, **options) -> None:
    write_delim(df, path, ",", **options)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write_delim(df, path, "\t", **options)


def read_fixed_width(
    spark: SparkSession,
    path: str,
    columns: Iterable[tuple[str | None, int]],
    *,
    types: ColumnTypes | dict | str | None = None,
    na: str = NA,
    skip: int = 0,
    row_id: bool = False,
) -> DataFrame:
    """Columns of fixed width, trimmed. Unnamed ones are X0, X1, ... by place."""
    columns = list(columns)
    names = numbered_duplicates([n if n is not None else f"X{i}" for i, (n, _) in enumerate(columns)])
    lines, at, cells = _lines(spark, readable(spark, path), skip), 1, []
    for name, (_, width) in zip(names, columns, strict=True):
        cell = F.trim(F.substring("value", at, width))
        cells.append(F.when(~cell.isin(na, ""), cell).alias(name))
        at += width
    df = apply_types(lines.where("length(value) > 0").select(*cells, ROW_ID), types, names)
    return df if row_id else df.drop(ROW_ID)


def write_fixed_width(df: DataFrame, path: str, columns: Iterable[tuple[str, int]], *, na: str = NA, mode: str = "errorifexists") -> None:
    """Lines of columns padded (and cut) to their widths."""
    cells = [F.rpad(F.coalesce(c(n).cast("string"), F.lit(na)), w, " ") for n, w in columns]
    df.select(F.concat(*cells).alias("value")).write.mode(mode).text(path)
