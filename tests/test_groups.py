"""Groups, aggregates, joins, binding."""

import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.functions import aggs as A
from tessera.functions import windows as W
from tessera.names import ROW_ID
from tessera.operators import bind as B
from tessera.operators import grouping as G
from tessera.operators import joins as J
from tessera.operators import verbs as V
from tessera.order import desc
from tessera.sources.builders import frame_of, from_columns


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def sales(spark):
    return frame_of(
        spark, ["product", "sales", "price"],
        ["A", None, 1.0, "A", 10, 2.0, "A", 50, None, "A", 10, 4.0, "B", 100, 5.0, "B", 150, 6.0, "B", None, 7.0, "B", 75, None], row_id=True,
    )


def test_summaries(spark, sales):
    by = G.group_by(sales, "product")
    assert rows(G.summarize(by, n=A.n(), s=A.total("sales", True), na=A.n_na("sales"))) == [("A", 4, 70, 1), ("B", 4, 325, 1)]
    with pytest.raises(Exception, match="MissingValueError"):
        G.summarize(by, s=A.mean("sales")).collect()
    with pytest.raises(E.InvalidColumnOperationError):
        G.summarize(by, s=A.mean("product"))
    with pytest.raises(E.NonScalarValueError):
        G.summarize(by, s=W.lag("sales"))
    with pytest.raises(E.DuplicatedColumnNameError):
        G.count(sales, "product", name="product")
    assert G.summarize(by.with_df(sales.where("false")), n=A.n()).count() == 0
    for data, want in (([1, 2, 3], 2.0), ([1, 2, 3, 4], 2.5), ([1], 1.0)):
        df = from_columns(spark, {"x": data})
        assert G.summarize(df, m=A.median("x")).first()[0] == want
    one = G.summarize(from_columns(spark, {"x": [4.0]}), sd=A.sd("x")).first()
    assert one["sd"] is None
    assert G.summarize(from_columns(spark, {"x": [1.0, 3.0]}), sd=A.sd("x")).first()["sd"] == 1.0
    empty = spark.createDataFrame([], "x int")
    got = G.summarize(empty, s=A.total("x"), m=A.mean("x"), lo=A.minimum("x")).first()
    assert (got["s"], got["m"], got["lo"]) == (0, None, None)


def test_groups(spark):
    df = from_columns(spark, {"k": ["a", None, "a", None], "v": [1, 2, 3, 4]})
    assert rows(G.count(G.group_by(df, "k"))) == [("a", 2), (None, 2)]
    assert sorted(g.count() for g in G.groups(G.group_by(df, "k"))) == [2, 2]
    assert G.grouped_by(G.group_by(df, "k")).count() == 2
    assert V.select(G.group_by(df, "k"), "v").columns == ["k", "v"]
    assert G.ungroup(G.rowwise(df)).columns == df.columns
    at = G.summarize_at(G.group_by(df, "k"), ["v"], A.SumFuns.mean, A.SumFuns.median, A.SumFuns.na)
    assert at.columns == ["k", "v.mean", "v.median", "v.na"] and rows(at) == [("a", 2.0, 2.0, 0), (None, 3.0, 3.0, 0)]
    hot = G.salted_summarize(G.group_by(df, "k"), 8, {"s": F.sum("v")}, {"s": F.sum})
    assert rows(hot) == [("a", 4), (None, 6)]


def test_windows(spark, sales):
    p = from_columns(spark, {"product": list("AAABBBB"), "sales": [32.3, 12.2, 24.2, 23.3, 12.3, None, 2.5]}, row_id=True)
    by = G.group_by(p, "product")
    got = [r["s"] for r in V.add_column(by, "s", W.cum_sum("sales")).df.orderBy(ROW_ID).collect()]
    assert got[:5] == pytest.approx([32.3, 44.5, 68.7, 23.3, 35.6]) and got[5:] == [None, None]
    pct = V.add_columns(G.group_by(sales, "product"), c=W.pct_change("sales")).df.orderBy(ROW_ID).collect()
    got = [r["c"] for r in pct]
    assert got[2] == 4.0 and got[3] == pytest.approx(-0.8) and got[5] == 0.5 and [got[i] for i in (0, 1, 4, 6, 7)] == [None] * 5
    q = from_columns(spark, {"sales": [10, 20, None, 40, 50], "price": [0.1, 0.2, None, 0.4, 0.5]}, row_id=True)
    out = V.add_columns(q, a=W.lead("sales"), b=W.lag("price", 2)).orderBy(ROW_ID).collect()
    assert [r["a"] for r in out] == [20, None, 40, 50, None] and [r["b"] for r in out] == [None, None, 0.1, 0.2, None]


@pytest.mark.parametrize("grouped", [False, True])
def test_fill(spark, grouped):
    df = from_columns(spark, {"g": ["x"] * 6, "v": [None, 1, None, None, 2, None]}, row_id=True)
    t = G.group_by(df, "g") if grouped else df
    want = {W.DOWN: [None, 1, 1, 1, 2, 2], W.UP: [1, 1, 2, 2, 2, None], W.DOWN_UP: [1, 1, 1, 1, 2, 2], W.UP_DOWN: [1, 1, 2, 2, 2, 2]}
    for direction, expected in want.items():
        out = G.ungroup(V.fill(t, "v", direction=direction)).orderBy(ROW_ID)
        assert [r["v"] for r in out.collect()] == expected
    out = G.ungroup(V.fill(t, "v", value=9)).orderBy(ROW_ID)
    assert [r["v"] for r in out.collect()] == [None, 1, 9, 9, 2, 9]
    out = G.ungroup(V.fill(t, "v", value="text")).orderBy(ROW_ID)
    assert [r["v"] for r in out.collect()] == [None, 1, None, None, 2, None]
    if not grouped:
        other = from_columns(spark, {"v": [7, 8, 9, 10, 11, 12]}, row_id=True)
        out = V.fill(df, "v", value=other).orderBy(ROW_ID)
        assert [r["v"] for r in out.collect()] == [7, 1, 9, 10, 2, 12]


def test_whole_frame_windows_against_lists(spark):
    import random

    rng = random.Random(5)
    data = [(i, rng.choice([None, *range(5)])) for i in range(300)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i int, v int").repartition(7)
    out = V.add_columns(df, n=W.row_number(), s=W.cum_sum("i"), d=W.filled("v"), u=W.filled("v", W.UP), order_by="i").orderBy("i").collect()
    data.sort()
    total, seen = 0, None
    for k, (r, (i, v)) in enumerate(zip(out, data, strict=True)):
        total, seen = total + i, v if v is not None else seen
        later = next((x for _, x in data[k:] if x is not None), None)
        assert (r["n"], r["s"], r["d"], r["u"]) == (k + 1, total, seen, later)


@pytest.mark.parametrize("kind", ["int", "string", "timestamp"])
def test_fill_in_descending_order(spark, kind):
    data = [(f"2024-01-01 00:00:{i:02d}" if kind == "timestamp" else f"{i:02d}", None if i % 3 else i) for i in range(40)]
    df = spark.createDataFrame(data, "k string, v int").withColumn("k", F.col("k").cast(kind)).repartition(3)
    down = [r["v"] for r in V.fill(df, "v", order_by=desc("k")).orderBy(F.desc("k")).collect()]
    up = [r["v"] for r in V.fill(df, "v", direction=W.UP, order_by=desc("k")).orderBy(F.desc("k")).collect()]
    assert up == [i - i % 3 for i in reversed(range(40))]
    assert down == [i if i % 3 == 0 else (i + 3 - i % 3 if i + 3 - i % 3 < 40 else None) for i in reversed(range(40))]


def test_joins(spark):
    foo = from_columns(spark, {"foo": ["a", "b", "c"], "bar": [2, 3, 4]})
    assert J.inner_join(foo, foo, "foo", suffixes=("_1", "_2")).columns == ["foo", "bar_1", "bar_2"]
    assert J.inner_join(foo, foo, "bar", suffixes=("_1", "_2")).columns == ["bar", "foo_1", "foo_2"]
    none = J.inner_join(foo, foo, [])
    assert none.count() == 0 and len(none.columns) == 4
    every = J.outer_join(foo, foo, [])
    assert every.count() == 6 and every.columns == ["foo.x", "bar.x", "foo.y", "bar.y"]
    people = from_columns(spark, {"name": ["max", "anna", "uwe"], "age": [23, 30, 41]})
    pets = from_columns(spark, {"name": ["max", "franz", None], "pet": ["cat", "dog", "cow"]})
    assert rows(J.outer_join(people, pets)) == [("anna", 30, None), ("franz", None, "dog"), ("max", 23, "cat"), ("uwe", 41, None), (None, None, "cow")]
    assert J.left_join(people.where("false"), pets).columns == ["name", "age", "pet"]
    weights = from_columns(spark, {"first": ["a", "b"], "last": ["max", "uwe"]})
    assert rows(J.inner_join(people, weights, [("name", "last")])) == [("max", 23, "a"), ("uwe", 41, "b")]
    assert rows(J.semi_join(people, pets)) == [("max", 23)]
    assert rows(J.anti_join(people, pets)) == [("anna", 30), ("uwe", 41)]
    assert J.cross_product(foo, foo).columns == ["foo", "bar", "foo_1", "bar_1"]


def test_joins_against_loops(spark):
    import random

    rng = random.Random(2)
    a = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x"]), i) for i in range(30)]
    b = [(rng.choice([None, 2, 3, 4]), rng.choice([None, "x"]), i) for i in range(30)]
    left, right = spark.createDataFrame(a, "k int, s string, i int"), spark.createDataFrame(b, "k int, s string, j int")
    want = [(k, s, i, j) for k, s, i in a for k2, s2, j in b if (k, s) == (k2, s2)]
    key = lambda r: str(r)
    assert sorted(map(tuple, J.inner_join(left, right).collect()), key=key) == sorted(want, key=key)
    lonely = [(k, s, i, None) for k, s, i in a if (k, s) not in {(x, y) for x, y, _ in b}]
    assert sorted(map(tuple, J.left_join(left, right).collect()), key=key) == sorted(want + lonely, key=key)


def test_binding(spark):
    a = from_columns(spark, {"x": [1, 2], "y": ["a", "b"]}, row_id=False)
    b = from_columns(spark, {"x": [1.5], "z": [True]})
    out = B.bind_rows(a, b)
    assert out.columns == ["x", "y", "z"] and rows(out) == [(1.0, "a", None), (1.5, None, True), (2.0, "b", None)]
    assert dict(B.bind_rows(from_columns(spark, {"x": [1]}), from_columns(spark, {"x": ["t"]})).dtypes)["x"] == "string"
    with pytest.raises(E.InvalidColumnOperationError):
        B.bind_rows(from_columns(spark, {"x": [1]}), from_columns(spark, {"x": [True]}))
    assert B.add_row(a, [3, None]).count() == 3
    with pytest.raises(ValueError):
        B.add_row(a, [1])
    more = B.bind_rows(a, {"x": 5}, {"w": "new"})
    assert more.columns == ["x", "y", "w"] and more.count() == 4
    p = from_columns(spark, {"a": [1, 2, 3]}, row_id=True)
    q = from_columns(spark, {"a": [4, 5, 6]}, row_id=True)
    side = B.bind_cols(p, q)
    assert side.columns == ["a", ROW_ID, "a_1", f"{ROW_ID}_1"] and sorted((r["a"], r["a_1"]) for r in side.collect()) == [(1, 4), (2, 5), (3, 6)]
    with pytest.raises(Exception, match="differ"):
        B.bind_cols(p, q.where("a < 6")).collect()


def test_streams_refuse_order(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(E.InvalidColumnOperationError):
        V.take(stream, 1, order_by="value")
    assert V.filter_rows(V.add_column(stream, "x", F.col("value") + 1), F.col("x") > 1).isStreaming
