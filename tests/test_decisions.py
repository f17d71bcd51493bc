"""Choices where usual libraries differ, one test each."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.functions import aggs as A
from tessera.functions import exprs as X
from tessera.functions import selectors as S
from tessera.functions import windows as W
from tessera.names import ROW_ID, c
from tessera.operators import bind as B
from tessera.operators import grouping as G
from tessera.operators import joins as J
from tessera.operators import reshape as R
from tessera.operators import verbs as V
from tessera.render import as_string
from tessera.sources import arrow_io, builders, delim


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_keys_are_compared_by_value_not_by_hash(spark):
    """Aa and BB have equal 32-bit string hashes in some runtimes."""
    a = builders.from_columns(spark, {"k": ["Aa", "BB", "C#"], "x": [1, 2, 3]})
    b = builders.from_columns(spark, {"k": ["BB", "Aa", "Bb"], "y": [10, 20, 30]})
    assert rows(J.inner_join(a, b, "k")) == [("Aa", 1, 20), ("BB", 2, 10)]
    assert V.distinct(a, "k", order_by="x").count() == 3


def test_missing_against_columns_and_constants(spark):
    df = spark.createDataFrame([(5, None), (None, 5), (None, None)], "a int, b int")
    got = [tuple(r) for r in df.select(X.gt("a", c("b")), X.gt("a", c("b"), na_as_lowest=True), X.le("a", c("b"), na_as_lowest=True), X.gt("a", 1)).collect()]
    assert got == [(False, True, False, True), (False, False, True, False), (False, False, True, False)]


def test_xor_is_exclusive(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(X.xor(c("a"), c("b"))).collect()] == [False, True, False, True]


def test_summary_names_and_functions(spark):
    df = builders.from_columns(spark, {"v": [1.0, 2.0, 9.0, None]})
    out = G.summarize_at(df, ["v"], lambda at: at.add(A.n_na).add(lambda v: A.median(v, True), "median").add(lambda v: A.mean(v, True), "mean"))
    assert out.columns == ["v.n_na", "v.median", "v.mean"] and rows(out) == [(1, 2.0, 4.0)]


def test_rows_keep_their_order_key_in_grouped_verbs(spark):
    df = builders.from_columns(spark, {"g": ["b", "a", "b", "a"], "v": [1, 2, 3, 4]}, row_id=True)
    out = G.ungroup(V.filter_rows(V.add_column(G.group_by(df, "g"), "w", W.lag("v")), X.is_not_na("w")))
    assert [(r["g"], r["w"]) for r in out.orderBy(ROW_ID).collect()] == [("b", 1), ("a", 2)]


def test_nested_column_has_the_asked_name(spark):
    df = builders.from_columns(spark, {"k": ["a", "b"], "v": [1, 2]})
    assert R.nest(df, ["v"], name="inner").columns == ["k", "inner"]
    assert R.nest(G.group_by(df, "k"), name="inner").columns == ["k", "inner"]


def test_arrow_files_are_read_whole(spark):
    table = pa.table({"x": pa.array(range(10), pa.int16()), "f": pa.array([0.5] * 10, pa.float32())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as w:
        for batch in table.to_batches(max_chunksize=3):
            w.write_batch(batch)
    df = arrow_io.read_arrow(spark, out.getvalue().to_pybytes())
    assert df.count() == 10 and df.dtypes == [("x", "int"), ("f", "double")]


def test_zip_is_told_by_its_content(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("t.csv", "a,b\n1,x\n")
    (tmp_path / "t.zip").write_bytes(buffer.getvalue())
    assert rows(delim.read_csv(spark, str(tmp_path / "t.zip"))) == [(1, "x")]


def test_blank_cells(spark, tmp_path):
    (tmp_path / "b.csv").write_text("n,t,all\n1,x,NA\n,,NA\n3,z,NA\n")
    df = delim.read_csv(spark, str(tmp_path / "b.csv"))
    assert df.dtypes[0] == ("n", "int") and df.dtypes[2] == ("all", "string")
    assert df.where("n is null").count() == 1


def test_numeric_equality_crosses_types(spark):
    df = spark.createDataFrame([(23.0, 23), (1.0, 2)], "a double, b int")
    assert [tuple(r) for r in df.select(X.eq("a", 23), X.eq("a", c("b"))).collect()] == [(True, True), (False, False)]


def test_integer_division_is_floating(spark):
    df = spark.createDataFrame([(7, 2)], "a int, b bigint")
    assert tuple(df.select(X.div("a", 2), X.div("b", 4), X.div("a", c("b"))).first()) == (3.5, 0.5, 3.5)


def test_row_predicates_ignore_groups(spark):
    df = builders.from_columns(spark, {"g": ["a", "b"], "v": [1, None]})
    assert V.filter_not_null(G.group_by(df, "g")).df.count() == 1
    assert V.filter_by_row(G.group_by(df, "g"), lambda r: r["g"] == "b").df.count() == 1


def test_joins_drop_groups_and_keys_come_first(spark):
    df = builders.from_columns(spark, {"v": [1, 2], "k": ["a", "b"]})
    out = J.inner_join(G.group_by(df, "k"), df, "k")
    assert out.columns == ["k", "v.x", "v.y"]


def test_clashes_after_suffixing_are_errors(spark):
    a = builders.from_columns(spark, {"k": [1], "v": [1], "v.x": [2]})
    with pytest.raises(E.DuplicatedColumnNameError):
        J.inner_join(a, builders.from_columns(spark, {"k": [1], "v": [3]}), "k")


def test_selector_errors_name_all_opinions(spark):
    df = builders.from_columns(spark, {"a": [1], "b": [2], "d": [3]})
    with pytest.raises(E.InvalidColumnSelectError, match=r"\+a, -b, <null>"):
        V.select(df, S.one_of("a"), ~S.one_of("b"))


def test_overflow_is_an_error_and_sums_are_wide(spark):
    df = spark.createDataFrame([(2147483647,), (1,)], "x int")
    assert G.summarize(df, s=A.total("x")).first()["s"] == 2147483648
    with pytest.raises(Exception, match="(?i)overflow"):
        V.add_column(df, "y", X.plus("x", 1)).collect()


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert G.summarize(G.group_by(df, "k"), n=A.n()).count() == 0
    assert V.add_row_number(df, order_by="v").count() == 0
    assert V.fill(df, "v", order_by="k").count() == 0
    assert R.gather(df, "a", "b", ["v"]).count() == 0
    assert B.bind_rows(df, df).count() == 0
    assert "0 x 2" in as_string(df)


def test_pushdown_and_exchanges(spark, tmp_path):
    """Filters and columns reach the scan; a grouped pipeline has one exchange and no Python."""
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = G.summarize(G.group_by(V.filter_rows(df, c("id") > 10), "k"), m=A.mean("id"), n=A.n())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "PushedFilters: [IsNotNull(id), GreaterThan(id,10)]" in plan
    assert "unused" not in plan and "Python" not in plan
    by = G.group_by(df, "k", order_by="id")
    many = V.add_columns(by, a=W.cum_sum("id"), b=W.lag("id"), d=W.filled("id"), e=lambda x: A.mean("id").build(x))
    plan = many.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    top = V.take(df, 3, order_by="id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
