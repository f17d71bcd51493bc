"""Arrow files. They are read where they lie, a file in each task; one file is written on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from .storage import put, readable


def _opened(data: pa.Buffer):
    try:
        return pa.ipc.open_file(data)
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(data)


def _batches(data: pa.Buffer) -> Iterator[pa.RecordBatch]:
    """All record batches of a file or a stream, small numbers widened."""
    found = _opened(data)
    wide = _widened(found.schema)
    many = isinstance(found, pa.ipc.RecordBatchFileReader)
    for batch in (found.get_batch(i) for i in range(found.num_record_batches)) if many else found:
        yield from pa.Table.from_batches([batch]).cast(wide).to_batches()


def read_arrow(spark: SparkSession, source: str | bytes) -> DataFrame:
    """Arrow files (file or stream format) of one schema below a path in any store, or an Arrow file's
    bytes. Executors read the files; only the schema of one comes to the driver."""
    if isinstance(source, bytes):
        return from_arrow(spark, _opened(pa.py_buffer(source)).read_all())
    files = spark.read.format("binaryFile").load(readable(spark, source)).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield pa.record_batch({"s": [_widened(_opened(raw.as_buffer()).schema).serialize().to_pybytes()]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield from _batches(raw.as_buffer())

    schema = pa.ipc.read_schema(pa.py_buffer(bytes(files.limit(1).mapInArrow(schema_of, "s binary").first()["s"])))
    return files.mapInArrow(read, from_arrow_schema(schema))


def _widened(schema: pa.Schema) -> pa.Schema:
    fields = []
    for f in schema:
        kind = f.type
        if pa.types.is_integer(kind) and kind.bit_width < 32:
            kind = pa.int32()
        elif pa.types.is_float16(kind) or pa.types.is_float32(kind):
            kind = pa.float64()
        fields.append(pa.field(f.name, kind))
    return pa.schema(fields)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table.cast(_widened(table.schema)))


def arrow_bytes(df: DataFrame) -> bytes:
    """The frame as an Arrow file in memory; it comes to the driver."""
    table = df.toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow file, to any store that Spark knows."""
    put(df.sparkSession, arrow_bytes(df), path)
