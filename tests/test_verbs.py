"""Columns, rows, order, sampling: golden values on small frames."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import errors as E
from tessera.functions import aggs as A
from tessera.functions import exprs as X
from tessera.functions import selectors as S
from tessera.functions import windows as W
from tessera.names import ROW_ID, c, numbered_duplicates, valid_identifier
from tessera.operators import grouping as G
from tessera.operators import verbs as V
from tessera.order import desc
from tessera.sources.builders import from_columns, frame_of


def values(df, *names):
    rows = df.orderBy(ROW_ID).collect() if ROW_ID in df.columns else df.collect()
    out = [tuple(r[n] for n in names) for r in rows]
    return [r[0] for r in out] if len(names) == 1 else out


@pytest.fixture(scope="module")
def users(spark):
    return frame_of(spark, ["user_id", "name"], [6, "maja", 3, "anna", None, "max", 5, None, 1, "tom", 5, "tom"], row_id=True)


@pytest.fixture(scope="module")
def iris(spark):
    rows = [(5.1, 3.5, "setosa"), (4.9, 3.0, "setosa"), (7.0, 3.2, "versicolor"), (6.3, 3.3, "virginica")]
    return spark.createDataFrame(rows, "`Sepal.Length` double, `Sepal.Width` double, Species string")


def test_select_and_remove(iris):
    assert V.select(iris, "Species", "Sepal.Width").columns == ["Species", "Sepal.Width"]
    assert V.select(iris, S.starts_with("Sepal")).columns == ["Sepal.Length", "Sepal.Width"]
    assert V.select(iris, S.starts_with("Sp"), S.ends_with("Width")).columns == ["Sepal.Width", "Species"]
    assert V.select(iris, ~S.one_of("Species")).columns == ["Sepal.Length", "Sepal.Width"]
    assert V.select(iris, S.col_range("Sepal.Width", "Species")).columns == ["Sepal.Width", "Species"]
    assert V.select(iris, S.everything()).columns == iris.columns
    assert V.select_type(iris, StringType).columns == ["Species"]
    assert V.remove(iris, "Species", "nothing").columns == ["Sepal.Length", "Sepal.Width"]
    # a negative selection of nothing keeps everything
    assert V.select(iris, S.except_("missing")).columns == iris.columns
    assert V.remove(iris, S.starts_with("zz")).columns == iris.columns
    with pytest.raises(E.UnknownColumnError):
        V.select(iris, "nothing")
    with pytest.raises(E.DuplicatedColumnNameError):
        V.select(iris, "Species", "Species")
    with pytest.raises(E.InvalidColumnSelectError):
        V.select(iris, S.starts_with("Sepal"), ~S.one_of("Species"))


def test_rename(iris):
    assert V.rename(iris, {"Sepal.Length": "Sepal.Width", "Sepal.Width": "Sepal.Length"}).columns == ["Sepal.Width", "Sepal.Length", "Species"]
    with pytest.raises(E.DuplicatedColumnNameError):
        V.rename(iris, {"Sepal.Length": "Species"})
    with pytest.raises(ValueError):
        V.set_names(iris, "a")
    by = V.rename(G.group_by(iris, "Species"), Species="kind")
    assert by.by == ("kind",)
    with pytest.raises(E.InvalidColumnOperationError):
        V.remove(G.group_by(iris, "Species"), "Species")


def test_add_columns(spark):
    df = frame_of(spark, ["product", "weight", "price", "n"], ["a", 2.0, 1.0, 33, "b", 1.0, 4.0, 33, "c", 2.5, 4.0, 20], row_id=True)
    out = V.add_columns(df, ratio=X.div("price", c("weight")), total=lambda x: x["n"] * x["price"], twice=lambda x: x["total"] * 2)
    assert values(out, "ratio") == [0.5, 4.0, 1.6]
    assert values(out, "twice") == [66.0, 264.0, 160.0]
    assert values(V.add_column(df, "price", 1), "price") == [1, 1, 1]
    assert V.transmute(df, x=c("n") + 1).columns == ["x"]
    assert values(V.add_column(df, "share", lambda x: x["n"] / A.total("n").build(x)), "share") == pytest.approx([33 / 86, 33 / 86, 20 / 86])
    assert values(V.add_row_number(df), "row_number") == [1, 2, 3]
    assert V.insert_column(df.drop(ROW_ID), 1, "x", 0).columns == ["product", "x", "weight", "price", "n"]


def test_filter(spark, users):
    df = from_columns(spark, {"x": [1, 2, 3, 4, 5, None]}, row_id=True)
    assert [V.filter_rows(df, p).count() for p in (X.gt("x", 2), X.ge("x", 2), X.lt("x", 2.0), X.le("x", 2))] == [3, 4, 1, 2]
    ab = spark.createDataFrame([(1, 1.5), (3, 2.5), (4, 4.0)], "a int, b double")
    assert [r[0] for r in ab.select(X.gt("a", c("b"))).collect()] == [False, True, False]
    assert [r[0] for r in ab.select(X.ge("a", c("b"))).collect()] == [False, True, True]
    assert V.filter_not_null(users).count() == 4
    assert V.filter_not_null(users, "user_id").count() == 5
    assert V.filter_by_row(users, lambda r: r["name"] == "tom").count() == 2
    assert V.filter_rows(users, X.is_matching("name", lambda v: v.startswith("m"), missing_as=True)).count() == 3
    assert V.filter_rows(users, X.in_list("name", ["tom", "max"])).count() == 3
    nulls = spark.createDataFrame([(None, None), (1, None), (None, 1)], "a int, b int")
    assert [r[0] for r in nulls.select(X.ge("a", c("b"), na_as_lowest=True)).collect()] == [True, True, False]
    assert [r[0] for r in nulls.select(X.xor(F.lit(True), F.lit(True))).collect()] == [False] * 3


def test_sort(spark, users):
    ids = [r["user_id"] for r in V.sorted_by(users, "user_id").collect()]
    assert ids == [1, 3, 5, 5, 6, None]
    down = V.sorted_by_desc(users, "user_id").collect()
    assert (down[0]["name"], down[-1]["name"]) == ("maja", "max")
    # secondary keys count after a descending key
    both = V.sorted_by(users, desc("user_id"), "name").collect()
    assert [r["name"] for r in both][:3] == ["maja", "tom", None]
    with pytest.raises(E.InvalidSortingPredicateError):
        V.sorted_by(users, "no such column")
    assert V.sorted_by(users) is users


def test_take_and_slice(spark):
    df = from_columns(spark, {"g": list("aabbb"), "v": [1, 2, 3, 4, 5]}, row_id=True)
    assert values(V.take(df, 2), "v") == [1, 2]
    assert sorted(values(V.tail(df, 2), "v")) == [4, 5]
    assert values(V.head(G.group_by(df, "g"), 1).df, "v") == [1, 3]
    assert values(V.take_last(G.group_by(df, "g"), 1).df, "v") == [2, 5]
    assert values(V.slice_rows(df, 1, 3, 9), "v") == [1, 3]
    assert values(V.slice_rows(G.group_by(df, "g"), range(2, 4)).df, "v") == [2, 4, 5]
    with pytest.raises(E.OrderRequiredError):
        V.take(df.drop(ROW_ID), 1)


def test_distinct(spark):
    df = from_columns(spark, {"a": [1, 1, 2, 2, None, None], "b": [1, 2, 1, 1, 3, 3], "c": [1, 2, 3, 4, 5, 6]}, row_id=True)
    assert values(V.distinct(df, "a", "b"), "c") == [1, 2, 3, 5]
    assert V.distinct(df.drop(ROW_ID, "c")).count() == 4


def test_rank_and_order(spark):
    y = [3.5, 3.0, 3.2, 3.1, 3.6, 3.9, 3.4, 3.4, 2.9, 3.1]
    df = from_columns(spark, {"y": y}, row_id=True)
    assert values(V.add_column(df, "r", W.rank("y")), "r") == [7, 1, 4, 2, 8, 9, 5, 6, 0, 3]
    assert W.order_positions(df, "y") == [8, 1, 3, 9, 2, 6, 7, 0, 4, 5]


def test_sampling(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert V.sample_n(df, 17).distinct().count() == 17
    assert V.sample_frac(df, 0.1234).count() == 123
    assert {r["n"] for r in G.count(V.sample_n(G.group_by(df, "g"), 5)).collect()} == {5}
    assert V.sample_n(df, 1500, replace=True).count() == 1500
    with pytest.raises(ValueError):
        V.sample_n(df, 1001)
    with pytest.raises(ValueError):
        V.sample_n(df, -1)
    with pytest.raises(Exception, match="more rows"):
        V.sample_n(G.group_by(df, "g"), 900).df.count()
    assert V.shuffle(df).count() == 1000


def test_categories(spark):
    df = from_columns(spark, {"k": ["x", "y", None, "x"]}, row_id=True)
    hot = V.one_hot(df, "k")
    assert hot.columns == [ROW_ID, "k[NA]", "k[x]", "k[y]"] and values(hot, "k[x]", "k[NA]") == [(1, 0), (0, 0), (0, 1), (1, 0)]
    assert [f["index"] for f in values(V.as_factor(df, "k"), "k")] == [0, 1, None, 0]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(X.div("a", c("b"))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] is None and got[4] == 1.5
    halves = spark.createDataFrame([(2.5,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in halves.select(X.to_ints("x", "double")).collect()] == [3, -2, None]
    text = spark.createDataFrame([("a", 1), (None, None)], "s string, i int")
    rows = text.select(X.concat_text("s", "!", text_column=True), X.concat_text("i", "!", text_column=False), X.concat_lists("s", "i"), X.to_strings("i", strict=True)).collect()
    assert tuple(rows[0]) == ("a!", "1!", "a 1", "1") and tuple(rows[1]) == (None, "NA!", "null null", "null")
    assert [r[0] for r in text.select(X.map_values("s", str.upper, "string")).collect()] == ["A", None]


def test_names():
    assert numbered_duplicates(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]
    assert valid_identifier("Sepal.Length") == "sepalLength" and valid_identifier("1 x") == "_1X"
