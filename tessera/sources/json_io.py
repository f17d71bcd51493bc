"""JSON tables: arrays of objects, and nested documents that are flattened level by level."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..names import c
from .builders import from_records
from .storage import beginning, readable

ID = "_id"


def read_json(spark: SparkSession, path: str, *, multiline: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """A file with an array of objects (or, with ``multiline`` off, an object on each line). Columns come
    in the order of the first object. Give a schema to avoid the pass that infers one."""
    path = readable(spark, path)
    reader = spark.read.option("multiLine", multiline)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    if schema is not None:
        return df
    names = _first_names(spark, df)
    order = [n for n in names if n in df.columns]
    return df.select(*[c(n) for n in [*order, *(n for n in df.columns if n not in order)]])


def _first_names(spark: SparkSession, df: DataFrame) -> list[str]:
    """Keys of the first object of the first file, of which the beginning is read, more while the object
    goes on."""
    files, size, decoder = sorted(df.inputFiles()), 1 << 16, json.JSONDecoder()
    while files:
        raw = beginning(spark, files[0], size)
        text = raw.decode("utf-8", "ignore")
        at = text.find("{")
        try:
            return list(decoder.raw_decode(text[at:])[0]) if at >= 0 else []
        except ValueError:
            if len(raw) < size:
                return []
            size *= 8
    return []


def _tolerant(text: str) -> Any:
    """JSON in which a comma may stand before a closing bracket."""
    out, inside, escaped = [], False, False
    for i, ch in enumerate(text):
        if inside:
            escaped = ch == "\\" and not escaped
            if ch == '"' and not (escaped or text[i - 1] == "\\" and not _even(text, i)):
                inside = False
        elif ch == '"':
            inside, escaped = True, False
        elif ch == "," and text[i + 1 :].lstrip()[:1] in ("]", "}"):
            continue
        out.append(ch)
    return json.loads("".join(out))


def _even(text: str, at: int) -> bool:
    n = 0
    while at - n - 1 >= 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 0


def _is_table(v: Any) -> bool:
    return isinstance(v, list) and all(isinstance(x, dict) for x in v) and bool(v)


def flatten_document(value: Any) -> list[dict[str, Any]]:
    """A nested document as rows. An array of objects is a table; an object whose first value is an
    array gives a column of its keys (named as the column it stood in) and goes on with its values;
    any other object gives a column for each key."""
    rows: list[dict[str, Any]] = [{ID: value}]
    while True:
        name = next((n for r in rows for n, v in r.items() if isinstance(v, dict) or _is_table(v)), None)
        if name is None:
            return rows
        keyed = any(isinstance(r.get(name), dict) and isinstance(next(iter(r[name].values()), None), list) for r in rows)
        new: list[dict[str, Any]] = []
        for r in rows:
            v, rest = r.get(name), {k: x for k, x in r.items() if k != name}
            if _is_table(v):
                new += [_merged(rest, x) for x in v]
            elif isinstance(v, dict) and keyed:
                new += [{**rest, name: k, "value": x} for k, x in v.items()]
            elif isinstance(v, dict):
                new.append(_merged(rest, v))
            else:
                new.append({**rest, name: v} if v is not None else rest)
        rows = new


def _merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        while k in out:
            k += "_1"
        out[k] = v
    return out


def from_json_string(spark: SparkSession, text: str) -> DataFrame:
    """A JSON document of any nesting, flattened to a table on the driver (it is a literal, after all)."""
    rows = flatten_document(_tolerant(text))
    names = list(dict.fromkeys(n for r in rows for n in r))
    full = [{n: r.get(n) for n in names} for r in rows]
    return from_records(spark, full)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as a JSON object with missing values kept: the distributed form of ``to_json_string``."""
    return df.select(F.to_json(F.struct(*[c(n) for n in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def to_json_array(df: DataFrame) -> list[dict[str, Any]]:
    return [json.loads(r["json"]) for r in json_rows(df).toLocalIterator()]


def to_json_object(df: DataFrame) -> dict[str, list[dict[str, Any]]]:
    """Objects grouped by ``_id``, or the first column."""
    key = ID if ID in df.columns else df.columns[0]
    out: dict[str, list] = {}
    for row in to_json_array(df):
        out.setdefault(str(row.pop(key)), []).append(row)
    return out


def to_json_string(df: DataFrame, pretty: bool = False, as_object: bool = False) -> str:
    return json.dumps(to_json_object(df) if as_object else to_json_array(df), indent=2 if pretty else None, ensure_ascii=False)
