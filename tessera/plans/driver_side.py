"""Queries for what goes through Python values, text or functions of users: literals, single rows and
columns, rendering, streams and cursors, user aggregates."""

from __future__ import annotations

import dataclasses
import io
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .. import access, render
from ..functions import aggs as A
from ..functions import windows as W
from ..names import c, valid_identifier
from ..operators import bind as B
from ..operators import grouping as G
from ..operators import verbs as V
from ..order import desc
from ..sources import builders, delim, jdbc, samples
from ..sources.storage import shared_path
from .tables import query


def _lines(t, text: str) -> DataFrame:
    found = text.split("\n")
    return builders.from_columns(t.spark, {"line_no": list(range(1, len(found) + 1)), "line": found})


def _sorted(df: DataFrame, key: str) -> list:
    return df.orderBy(key).collect()


# ------------------------------------------------------------ sources


@query("SELECT r_regionkey, r_name FROM region")
def q_stream_roundtrip(t):
    text = "r_regionkey,r_name\n" + "".join(f"{r[0]},{r[1]}\n" for r in _sorted(t.region, "r_regionkey"))
    return delim.read_stream(t.spark, io.BytesIO(text.encode()))


@query("""SELECT CAST(c_custkey AS INT) AS "X1", c_mktsegment AS "X2" FROM customer""")
def q_headerless_skip(t):
    path = shared_path(t.spark, "headerless")
    note = t.spark.range(1, numPartitions=1).select(F.lit("# a note").alias("value"))
    note.unionByName(t.customer.select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value"))).coalesce(1).write.text(path)
    return delim.read_csv(t.spark, path, header=False, skip=1)


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")
def q_cursor_rows(t):
    db = sqlite3.connect(":memory:")
    db.execute("create table nation (n_nationkey integer, n_name text)")
    db.executemany("insert into nation values (?, ?)", [(r[0], r[1]) for r in t.nation.select("n_nationkey", "n_name").collect()])
    return jdbc.from_cursor(t.spark, db.execute("select n_nationkey, n_name from nation"))


@query("SELECT * FROM (VALUES (1, 'a', TRUE, 1.5::DOUBLE), (2, NULL, FALSE, 2.0::DOUBLE), (NULL, 'c', NULL, NULL)) v(i, s, b, d)")
def q_from_columns(t):
    return builders.from_columns(t.spark, {"i": [1, 2, None], "s": ["a", None, "c"], "b": [True, False, None], "d": [1.5, 2, None]})


@query("SELECT r_regionkey AS key, CAST(length(r_name) AS INT) AS letters, lower(r_name) AS name FROM region")
def q_deparse_records(t):
    objects = _sorted(t.region, "r_regionkey")
    return builders.deparse_records(t.spark, objects, key=lambda r: r[0], letters=lambda r: len(r[1]), name=lambda r: r[1].lower())


@query("SELECT r_regionkey, r_name FROM region")
def q_empty_frame(t):
    return B.bind_rows(builders.empty_frame(t.spark), t.region)


@query("""SELECT * FROM (VALUES ('flights', 336776::BIGINT, 16), ('flowers', 150, 5), ('sleep', 83, 11)) v(name, n_rows, n_columns)""")
def q_sample_tables(t):
    found = {"flights": samples.flights(t.spark), "flowers": samples.flowers(t.spark), "sleep": samples.sleep(t.spark)}
    counts = [V.add_columns(G.count(df, name="n_rows"), name=F.lit(n), n_columns=F.lit(len(df.columns))) for n, df in found.items()]
    return B.bind_rows(*[V.select(x, "name", "n_rows", "n_columns") for x in counts])


# ------------------------------------------------------------ rendering


@query("""WITH r AS (SELECT n_nationkey AS k, n_name AS s, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), f AS (SELECT * FROM r WHERE i <= 10),
w AS (SELECT max(length(i::VARCHAR)) AS wi, greatest(11, max(length(k::VARCHAR))) AS wk, greatest(6, max(length(s))) AS ws FROM f), n AS (SELECT count(*) AS n FROM r)
SELECT 1 AS line_no, 'A data frame: ' || n || ' x 2' AS line FROM n
UNION ALL SELECT 2, lpad('', wi::INT, ' ') || '   ' || lpad('n_nationkey', wk::INT, ' ') || '   ' || lpad('n_name', ws::INT, ' ') FROM w
UNION ALL SELECT CAST(i + 2 AS INT), lpad(i::VARCHAR, wi::INT, ' ') || '   ' || lpad(k::VARCHAR, wk::INT, ' ') || '   ' || lpad(s, ws::INT, ' ') FROM f, w
UNION ALL SELECT 13, 'and ' || (n - 10) || ' more rows' FROM n WHERE n > 10""")
def q_render_text(t):
    return _lines(t, render.as_string(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey")))


@query("""SELECT 1 AS line_no, 'DataFrame with ' || count(*) || ' observations' AS line FROM region
UNION ALL SELECT 2, 'r_regionkey  [Int]  ' || string_agg(r_regionkey::VARCHAR, ', ' ORDER BY r_regionkey) FROM region
UNION ALL SELECT 3, 'r_name       [Str]  ' || string_agg(r_name, ', ' ORDER BY r_regionkey) FROM region""")
def q_render_schema(t):
    return _lines(t, render.schema_string(t.region.orderBy("r_regionkey")))


@query("""SELECT * FROM (VALUES (0, 's_suppkey', 'Long'), (1, 's_name', 'Str'), (2, 's_nationkey', 'Int'), (3, 's_acctbal', 'Dbl')) v("index", name, type)""")
def q_column_types(t):
    return render.column_types(t.supplier)


@query("""SELECT 1 AS line_no, '<html><body><h3>Regions</h3><table><tr><th style="text-align:left">r_regionkey</th><th style="text-align:left">r_name</th></tr>'
|| string_agg('<tr><td title="' || r_regionkey || '">' || r_regionkey || '</td><td title="' || r_name || '">' || r_name || '</td></tr>', '' ORDER BY r_regionkey)
|| '</table><p>Shape: ' || count(*) || ' x 2.</p></body></html>' AS line FROM region""")
def q_render_html(t):
    return _lines(t, render.to_html(t.region.orderBy("r_regionkey"), title="Regions"))


@query("""SELECT * FROM (VALUES (1, 'A data frame: 4 x 1'), (2, '         x'), (3, '     1.235'), (4, '         2'), (5, '      <NA>'), (6, '-1234567.1')) v(line_no, line)""")
def q_number_format(t):
    numbers = builders.from_columns(t.spark, {"x": [1.23456, 2.0, None, -1234567.1]})
    return _lines(t, render.as_string(numbers.coalesce(1), row_numbers=False))


# ------------------------------------------------------------ values on the driver


@query("SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation")
def q_to_matrix(t):
    m = builders.to_matrix(V.select(t.nation, "n_nationkey", "n_regionkey"))
    return builders.from_columns(t.spark, {"a": m[:, 0].tolist(), "b": m[:, 1].tolist()})


@query("SELECT r_regionkey, r_name FROM region")
def q_to_map(t):
    return builders.from_columns(t.spark, builders.to_map(t.region))


@dataclasses.dataclass
class _Nation:
    key: int
    n_name: str


@query("SELECT n_nationkey AS key, n_name FROM nation")
def q_rows_as_objects(t):
    return builders.from_objects(t.spark, builders.rows_as(t.nation, _Nation, {"key": "n_nationkey"}))


@query("""SELECT * FROM (VALUES (1, '@dataclass'), (2, 'class Event:'), (3, '    event_id: int'), (4, '    user_id: int | None'),
(5, '    event_type: str'), (6, '    value: float | None')) v(line_no, line)""")
def q_data_class_source(t):
    return _lines(t, builders.data_class_source(t.holes, "Event"))


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def q_rows_and_columns(t):
    first = access.row(t.nation, 0, order_by="n_nationkey")
    rest = [r for r in access.rows(t.nation) if r["n_nationkey"] != first["n_nationkey"]]
    df = builders.from_records(t.spark, [first, *rest])
    return df.select(access.column(df, 0), F.upper(access.column(df, "n_name")).alias("name"))


@query("SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def q_shape(t):
    n_rows, n_columns = render.shape(t.lineitem)
    return t.spark.createDataFrame([(n_rows, n_columns)], "n_rows long, n_columns long")


@query("SELECT TRUE AS itself, TRUE AS other_order, FALSE AS other_rows, FALSE AS other_names")
def q_frames_equal(t):
    o = V.select(t.orders, "o_orderkey", "o_totalprice")
    cases = {"itself": o, "other_order": o.orderBy(desc("o_totalprice").key), "other_rows": o.unionAll(o.limit(1)), "other_names": V.set_names(o, "a", "b")}
    return builders.from_columns(t.spark, {n: [render.equal(o, x)] for n, x in cases.items()})


@query("SELECT CAST(row_number() OVER (ORDER BY s_acctbal, p) - 1 AS INT) AS i, CAST(p AS INT) AS place FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) q")
def q_order_positions(t):
    found = W.order_positions(V.select(t.supplier, "s_suppkey", "s_acctbal"), "s_acctbal", order_by="s_suppkey")
    return builders.from_columns(t.spark, {"i": range(len(found)), "place": found})


@query("SELECT r_regionkey, CAST(sum(r_regionkey) OVER (ORDER BY r_regionkey) AS INT) AS total FROM region")
def q_list_cum_sum(t):
    found = access.values(t.region, "r_regionkey", order_by="r_regionkey")
    return builders.from_columns(t.spark, {"r_regionkey": found, "total": W.list_cum_sum(found)})


@query("SELECT round(avg(n_regionkey), 9) AS mean, median(n_regionkey) AS median, round(stddev_pop(n_regionkey), 9) AS sd FROM nation")
def q_list_summaries(t):
    found = access.values(t.nation, "n_regionkey")
    return builders.from_columns(
        t.spark, {"mean": [round(A.list_mean(found), 9)], "median": [float(A.list_median(found))], "sd": [round(A.list_sd(found), 9)]}
    )


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN n_name || '!' END AS said FROM nation")
def q_map_not_null(t):
    rows = _sorted(t.nation, "n_nationkey")
    said = access.map_not_null([r["n_name"] if r["n_regionkey"] else None for r in rows], lambda v: v + "!")
    return builders.from_columns(t.spark, {"n_nationkey": [r["n_nationkey"] for r in rows], "said": said})


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INT) AS place FROM nation")
def q_column_values(t):
    found = access.values(t.nation, 1, order_by=desc("n_name"))
    return builders.from_columns(t.spark, {"n_name": found, "place": range(len(found))})


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def q_as_type(t):
    o = t.orders
    return o.select(access.as_type(o, "o_orderkey", LongType), access.as_type(o, "o_orderstatus", StringType))


@query("""SELECT * FROM (VALUES ('a b', 'aB'), ('Sepal.Length', 'sepalLength'), ('2 x', '_2X'), ('ok', 'ok'), ('-', '_')) v(name, identifier)""")
def q_valid_identifier(t):
    names = ["a b", "Sepal.Length", "2 x", "ok", "-"]
    return builders.from_columns(t.spark, {"name": names, "identifier": [valid_identifier(n) for n in names]})


# ------------------------------------------------------------ groups, order


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def q_group_frames(t):
    one = lambda g: g.agg(F.first("c_mktsegment").alias("c_mktsegment"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return B.bind_rows(*map(one, G.groups(G.group_by(V.select(t.customer, "c_mktsegment", "c_acctbal"), "c_mktsegment"))))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def q_sort_grouped(t):
    by = G.group_by(V.select(t.orders, "o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus")
    return G.ungroup(V.sorted_by(by, desc("o_totalprice"), "o_orderkey"))


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size DESC, p_partkey DESC")
def q_sort_by_desc(t):
    return V.sorted_by_desc(V.select(t.part, "p_brand", "p_size", "p_partkey"), "p_brand", "p_size", "p_partkey")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def q_remove_if(t):
    return V.remove_if(t.part, lambda f: f.dataType.typeName() == "string")


# ------------------------------------------------------------ functions of users


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def q_aggregate_any(t):
    return G.summarize(G.group_by(t.nation, "n_regionkey"), names=A.aggregate(F.array_join(F.array_sort(F.collect_list("n_name")), ";")))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def q_user_aggregate(t):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return G.summarize(G.group_by(t.customer, "c_nationkey"), spread=A.aggregate(F.round(spread(c("c_acctbal")), 4)))


@query("""SELECT o_orderpriority, min(o_orderkey) AS first_key, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1""")
def q_user_summary(t):
    by = G.group_by(V.select(t.orders, "o_orderpriority", "o_orderkey"), "o_orderpriority")
    one = lambda g: pd.DataFrame({"o_orderpriority": [g["o_orderpriority"].iloc[0]], "first_key": [g["o_orderkey"].min()], "n": [len(g)]})
    return G.summarize_udf(by, one, "o_orderpriority string, first_key long, n int")


@query("SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS DOUBLE) AS s_acctbal FROM supplier")
def q_user_column(t):
    by = G.group_by(V.select(t.supplier, "s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey")
    return G.ungroup(G.transform_groups(by, lambda g: g.assign(s_acctbal=g["s_acctbal"].rank(method="min"))))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1")
def q_table_function(t):
    def above_mean(df: DataFrame, name: str) -> DataFrame:
        return V.filter_rows(df, lambda x: x[name] > A.mean(name).build(x))

    return G.count(V.select(t.orders, "o_orderstatus", "o_totalprice").transform(above_mean, "o_totalprice"), "o_orderstatus")
