"""Files in any store that Spark knows, and the folder that driver and executors share.

What comes from elsewhere (a URL, an archive, an open stream) is put into the shared folder as it
flows, so that executors can read it; nothing is held whole.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_URL = ("http://", "https://", "ftp://")
_CHUNK = 1 << 20


def is_url(path: str) -> bool:
    return path.lower().startswith(_URL)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
    temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}-{name}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def put(spark: SparkSession, data: bytes | io.IOBase, path: str) -> str:
    """Write bytes, or what an open stream gives, to the path."""
    fs, where = _at(spark, path)
    stream, out = io.BytesIO(data) if isinstance(data, bytes) else data, fs.create(where, True)
    try:
        while part := stream.read(_CHUNK):
            out.write(bytearray(part.encode() if isinstance(part, str) else part))
    finally:
        out.close()
    return path


def beginning(spark: SparkSession, path: str, size: int) -> bytes:
    """Up to so many bytes of a file, unpacked if its name says that it is compressed."""
    fs, where = _at(spark, path)
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    stream = fs.open(where)
    try:
        held = codec.createInputStream(stream) if codec is not None else stream
        return bytes(held.readNBytes(size))
    finally:
        stream.close()


def _copied(spark: SparkSession, stream, name: str) -> str:
    path = shared_path(spark, name)
    fs, where = _at(spark, path)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, fs.create(where, True), spark._jsc.hadoopConfiguration(), True)
    return path


def readable(spark: SparkSession, path: str) -> str:
    """A path that executors can read: a URL is copied to the shared folder, and a .zip that holds an
    archive (by its first bytes) is unpacked there, its first entry. Everything else Spark reads itself."""
    jvm = spark._jvm
    if is_url(path):
        name = os.path.basename(path.split("?")[0].split("#")[0]) or "content"
        path = _copied(spark, jvm.java.net.URI(path).toURL().openStream(), name)
    if path.lower().endswith(".zip"):
        fs, where = _at(spark, path)
        if fs.exists(where) and not fs.getFileStatus(where).isDirectory():
            raw = beginning(spark, path, 4)
            if raw == b"PK\x03\x04":
                entries = jvm.java.util.zip.ZipInputStream(fs.open(where))
                return _copied(spark, entries, os.path.basename(entries.getNextEntry().getName()))
            if raw[:2] == b"\x1f\x8b":
                return _copied(spark, jvm.java.util.zip.GZIPInputStream(fs.open(where)), "content")
            return _copied(spark, fs.open(where), "content")
    return path
