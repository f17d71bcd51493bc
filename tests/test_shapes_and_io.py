"""Reshaping, readers, writers, builders, rendering."""

import dataclasses
import gzip
import io
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera import errors as E
from tessera import render
from tessera.functions import selectors as S
from tessera.names import ROW_ID
from tessera.operators import grouping as G
from tessera.operators import reshape as R
from tessera.sources import arrow_io, builders, delim, excel, jdbc, json_io
from tessera.sources.typeguess import Compact


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def people(spark):
    return builders.frame_of(
        spark, ["person", "year", "weight", "sex"],
        ["max", 2014, 33.1, "M", "max", 2015, 32.3, "M", "max", 2016, None, "M", "anna", 2013, 33.5, "F", "anna", 2014, 37.3, "F",
         "anna", 2015, 39.2, "F", "anna", 2016, 39.9, "F"],
    )


def test_spread_and_gather(spark, people):
    wide = R.spread(people, "year", "weight")
    assert wide.columns == ["person", "sex", "2013", "2014", "2015", "2016"] and wide.count() == 2
    assert {t for n, t in wide.dtypes if n[0] == "2"} == {"double"}
    back = R.gather(wide, "year", "weight", S.matches("20.."), convert=True)
    assert back.count() == 8 and dict(back.dtypes)["year"] == "int"
    assert rows(back.where("weight is not null").select("person", "year", "weight")) == rows(people.where("weight is not null").select("person", "year", "weight"))
    twice = people.unionAll(people)
    with pytest.raises(Exception, match="tell the rows apart"):
        R.spread(twice, "year", "weight").collect()
    props = builders.frame_of(spark, ["person", "property", "value"], ["anna", "salary", "23.3", "anna", "city", "Berlin", "max", "salary", "19"])
    typed = R.spread(props, "property", "value", convert=True)
    assert dict(typed.dtypes) == {"person": "string", "city": "string", "salary": "double"}
    mixed = builders.frame_of(spark, ["id", "a", "b"], [1, 10, 3000000000, 2, 20, 5])
    assert dict(R.gather(mixed, "k", "v", ["a", "b"]).dtypes)["v"] == "bigint"


def test_unite_and_separate(spark):
    df = builders.from_columns(spark, {"a": ["x", None], "b": [1, 2]})
    both = R.unite(df, "ab", ["a", "b"])
    assert rows(both) == [("NA_2",), ("x_1",)]
    assert rows(R.separate(both, "ab", ["a", "b"], sep="_", convert=True)) == [("NA", 2), ("x", 1)]
    gone = builders.from_columns(spark, {"t": ["a b", None]})
    assert rows(R.separate(gone, "t", ["p", "q"])) == [("a", "b"), (None, None)]
    with pytest.raises(Exception, match="split into 3"):
        R.separate(both, "ab", ["a", "b", "c"], sep="_").collect()


def test_nesting(spark, people):
    nested = R.nest(G.group_by(people, "person"))
    assert nested.columns == ["person", "data"] and nested.count() == 2
    assert rows(R.unnest(nested, "data").select(*people.columns)) == rows(people)
    assert R.nest(people).count() == 1
    tags = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", []), ("d", None)], "id string, tags array<string>")
    assert rows(R.unnest(tags, "tags")) == [("a", "x"), ("a", "y"), ("b", "z"), ("d", None)]
    cars = spark.createDataFrame([((120, "VW"),), ((80, "Fiat"),)], "car struct<ps:int,brand:string>")
    assert R.unfold(cars, "car", add_prefix=True).columns == ["car", "car.ps", "car.brand"]
    assert R.unfold(cars, "car", ["brand"], keep=False).columns == ["brand"]
    assert rows(R.flatten(cars)) == [(120, "VW"), (80, "Fiat")]


def test_expand_and_complete(people):
    assert R.expand(people, "year", "sex").count() == 8
    full = R.complete(people, "year", "person")
    assert full.count() == 8 and full.where("weight is null").count() == 2


def test_type_guesses(spark, tmp_path):
    text = "a,b,c,d,e,f\n" + "".join(f"v{i},{i if i < 6 else 'x'},{i + 0.141 if i == 6 else i},{i},{'TRUE' if i % 2 else 'f'},{10**13 if i == 3 else i}\n" for i in range(7))
    path = tmp_path / "t.csv"
    path.write_text(text)
    df = delim.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["string", "string", "double", "int", "boolean", "bigint"]
    assert [t for _, t in delim.read_csv(spark, str(path), types=Compact("ssdibl")).dtypes] == ["string", "string", "double", "int", "boolean", "bigint"]
    assert dict(delim.read_csv(spark, str(path), types={"d": "string", ".default": "string"}).dtypes)["f"] == "string"
    na = tmp_path / "na.csv"
    na.write_text("a\n" + "CUSTOM_NA\n" * 5 + "\n".join(map(str, range(6, 11))) + "\n")
    custom = delim.read_csv(spark, str(na), na="CUSTOM_NA")
    assert dict(custom.dtypes) == {"a": "int"} and custom.where("a is null").count() == 5
    with pytest.raises(ValueError):
        Compact("zz")


def test_delimited(spark, tmp_path):
    body = "# preamble\n# more\n1\tab\t1.5\n2\tcd\t2.5\n"
    (tmp_path / "h.txt").write_text(body)
    df = delim.read_tsv(spark, str(tmp_path / "h.txt"), header=False, skip=2)
    assert df.columns == ["X1", "X2", "X3"] and rows(df) == [(1, "ab", 1.5), (2, "cd", 2.5)]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("x,x\n1,NA\n")
    z = delim.read_csv(spark, str(tmp_path / "z.csv.gz"))
    assert z.columns == ["x", "x_2"] and rows(z) == [(1, None)]
    assert rows(delim.read_stream(spark, io.BytesIO(gzip.compress(b"p;q\n1;2\n")), ";")) == [(1, 2)]
    src = builders.from_columns(spark, {"t": ['say "hi", you', None, "line"], "n": [1, None, 3]})
    delim.write_csv(src, str(tmp_path / "out"), single_file=True)
    assert rows(delim.read_csv(spark, str(tmp_path / "out"), types="si")) == rows(src)
    (tmp_path / "fw.txt").write_text("A1        12  \nB2        NA  \n")
    assert rows(delim.read_fixed_width(spark, str(tmp_path / "fw.txt"), [("k", 10), (None, 4)])) == [("A1", 12), ("B2", None)]


def test_json(spark, tmp_path):
    cars = '{"cars": {"Nissan": [{"model": "A", "doors": 4, "weight": 1}, {"model": "B", "doors": 2, "weight": 1.5},], "Ford": [{"model": "K", "doors": 3}]}}'
    df = json_io.from_json_string(spark, cars)
    assert df.columns == ["cars", "model", "doors", "weight"] and df.count() == 3 and dict(df.dtypes)["weight"] == "double"
    root = json_io.from_json_string(spark, '{"Nissan": [{"model": "A"}, {"model": "B, ]"}]}')
    assert root.columns == ["_id", "model"] and rows(root) == [("Nissan", "A"), ("Nissan", "B, ]")]
    assert json_io.from_json_string(spark, '[{"b": 1, "a": 2}]').columns == ["b", "a"]
    (tmp_path / "a.json").write_text('[{"z": 1, "a": null}, {"z": 2, "a": "t"}]')
    assert json_io.read_json(spark, str(tmp_path / "a.json")).columns == ["z", "a"]
    assert json_io.to_json_array(builders.from_columns(spark, {"z": [1], "a": [None]})) == [{"z": 1, "a": None}]
    assert json_io.to_json_object(root)["Nissan"][0] == {"model": "A"}


def test_arrow(spark):
    df = builders.from_columns(spark, {"a": [1, None], "b": ["x", "y"], "c": [True, None], "d": [1.5, 2.0]})
    assert rows(arrow_io.read_arrow(spark, arrow_io.arrow_bytes(df))) == rows(df)


def test_excel(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    df = builders.from_columns(spark, {"Name": ["a <&>", "b", None], "N": [1, 2, 3], "Ok": [True, False, None], "X": [1.5, None, 2.0]})
    excel.write_excel(df, path, "first")
    excel.write_excel(df.limit(1), path, "second", bold_headers=False)
    assert rows(excel.read_excel(spark, path, "first")) == rows(df)
    assert excel.read_excel(spark, path, 1).count() == 1
    assert excel.read_excel(spark, path, "first", "A1:B3").columns == ["Name", "N"]
    with pytest.raises(ValueError):
        excel.read_excel(spark, path, "third")


def test_cursor(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create table cars (id integer, name text, price real)")
    db.executemany("insert into cars values (?, ?, ?)", [(1, "vw", 1.5), (2, None, None)])
    assert rows(jdbc.from_cursor(spark, db.execute("select * from cars"))) == [(1, "vw", 1.5), (2, None, None)]


@dataclasses.dataclass
class User:
    first: str | None
    age: int
    sudo: bool | None = None


def test_objects(spark):
    df = builders.from_objects(spark, [User("a", 1, True), User(None, 2)])
    assert df.columns == ["age", "first", "sudo"]
    assert list(builders.rows_as(df, User)) == [User("a", 1, True), User(None, 2, None)]
    other = df.withColumnRenamed("age", "years")
    assert next(builders.rows_as(other, User, {"age": "years"})).age == 1
    with pytest.raises(TypeError):
        list(builders.rows_as(other, User))
    source = builders.data_class_source(df, "User")
    assert "first: str | None" in source and "age: int\n" in source + "\n"
    wide = builders.deparse_records(spark, [1, 2], n=lambda x: x, sq=lambda x: x * x)
    assert rows(wide) == [(1, 1), (2, 4)]
    assert dict(builders.from_columns(spark, {"s": [1, 2.5, None]}).dtypes) == {"s": "double"}
    assert builders.to_matrix(wide).tolist() == [[1, 1], [2, 4]]
    with pytest.raises(E.InvalidColumnOperationError):
        builders.to_matrix(df)
    assert builders.to_map(wide) == {"n": [1, 2], "sq": [1, 4]}
    assert builders.empty_frame(spark).columns == []
    with pytest.raises(ValueError):
        builders.frame_of(spark, ["a", "b"], [1])


def test_rendering(spark):
    df = builders.from_columns(spark, {"a": [1.23456, None], "name": ["x", "y"]})
    text = render.as_string(df)
    assert "1.235" in text and "<NA>" in text and text.startswith("A data frame: 2 x 2")
    assert "and 1 more rows" in render.as_string(df, rows=1)
    assert "[Dbl]" in render.schema_string(df)
    assert rows(render.column_types(df)) == [(0, "a", "Dbl"), (1, "name", "Str")]
    assert "Shape: 2 x 2" in render.to_html(df)
    assert render.equal(df, df.orderBy(F.desc("name"))) and not render.equal(df, df.limit(1))
    assert render.shape(df) == (2, 2)


def test_row_ids(spark, tmp_path):
    (tmp_path / "r.csv").write_text("v\n" + "\n".join(map(str, range(50))) + "\n")
    df = delim.read_csv(spark, str(tmp_path / "r.csv"), row_id=True)
    assert [r["v"] for r in df.orderBy(ROW_ID).collect()] == list(range(50))


def test_samples_access_and_timing(spark):
    import tessera as t
    from pyspark.sql.types import DoubleType, StringType
    from tessera.access import map_not_null
    from tessera.sources import samples
    from tessera.timing import measure

    iris = samples.flowers(spark)
    assert t.shape(iris) == (150, 5) and rows(t.count(iris, "Species")) == [("setosa", 50), ("versicolor", 50), ("virginica", 50)]
    sleep = samples.sleep(spark)
    assert t.shape(sleep) == (83, 11) and t.filter_rows(sleep, t.is_na("vore")).count() > 0
    assert t.shape(samples.flights(spark, 1000)) == (1000, 16)
    assert t.row(iris, 0, order_by=["Species", "Sepal.Length"])["Species"] == "setosa"
    with pytest.raises(IndexError):
        t.row(iris, 500, order_by="Species")
    assert len(t.values(iris, 4)) == 150 and len(list(t.rows(sleep))) == 83
    t.as_type(iris, "Species", StringType)
    with pytest.raises(E.ColumnTypeCastError):
        t.as_type(iris, "Species", DoubleType)
    with pytest.raises(E.UnknownColumnError):
        t.column(iris, 9)
    assert map_not_null([1, None], str) == ["1", None]
    assert str(measure("nothing", lambda: None, runs=3)).endswith("N=3")
    ranked = t.transform_groups(t.group_by(iris, "Species"), lambda g: g.head(1))
    assert ranked.df.count() == 3
    by = t.one_hot(iris, "Sepal.Length", categorize=lambda v: F.when(v > 5.8, "long").otherwise("short"))
    assert {"Sepal.Length[long]", "Sepal.Length[short]"} <= set(by.columns)


# ------------------------------------------------------------ files in any store


def test_skip_counts_lines_of_each_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a note\nid,name\n" + "".join(f"{k}{i},n{i}\n" for i in range(400)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several splits of a file
        df = delim.read_csv(spark, str(tmp_path), skip=1, types="is")
        assert df.columns == ["id", "name"]
        assert rows(df) == sorted(((int(f"{k}{i}"), f"n{i}") for k in range(3) for i in range(400)), key=lambda r: tuple((False, str(x)) for x in r))
        wide = delim.read_fixed_width(spark, str(tmp_path), [("a", 2), ("b", 90)], skip=2, types="ss")
        assert wide.count() == 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_type_guesses_take_two_jobs(spark, tmp_path):
    names = [f"c{i}" for i in range(30)]
    line = lambda i: ",".join(str(i * k) if k % 3 else (f"{i}.5" if k % 2 else f"w{i}") for k in range(30))
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + "\n".join(line(i) for i in range(300)) + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("guesses", "guesses")
    df = delim.read_csv(spark, str(tmp_path / "w.csv"))
    jobs = len(tracker.getJobIdsForGroup("guesses"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert [k for _, k in df.dtypes] == ["string" if k % 6 == 0 else "double" if k % 3 == 0 else "int" for k in range(30)]
    assert jobs <= 7, jobs  # the header, the first rows, the aggregate; adaptive plans count their stages


def test_sparse_columns_are_judged_by_all_values(spark, tmp_path):
    cells = ["NA"] * 1500 + ["1", "2", "x"] + ["NA"] * 5
    (tmp_path / "s.csv").write_text("n,s\n" + "\n".join(f"{i},{v}" for i, v in enumerate(cells)) + "\n")
    df = delim.read_csv(spark, str(tmp_path / "s.csv"))
    assert df.dtypes == [("n", "int"), ("s", "string")] and rows(df.where("s is not null").select("s")) == [("1",), ("2",), ("x",)]


def test_json_names_of_long_objects(spark, tmp_path):
    first = {f"z{99 - i}": "v" * 3000 for i in range(60)}
    (tmp_path / "a.json").write_text(__import__("json").dumps([first, {"z0": "x"}]))
    assert json_io.read_json(spark, str(tmp_path / "a.json")).columns == [*first, "z0"]
    (tmp_path / "l.json").write_text('{"b": 1, "a": 2}\n{"b": 3, "a": 4}\n')
    assert json_io.read_json(spark, str(tmp_path / "l.json"), multiline=False).columns == ["b", "a"]


def test_nested_rows_in_descending_order(spark):
    from tessera.order import desc

    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (1, "c", 3), (1, "b", 4), (1, "b", 5)], "g int, t string, n int")
    nested = R.nest(G.group_by(df, "g"), order_by=[desc("t"), "n"]).first()["data"]
    assert [(r["t"], r["n"]) for r in nested] == [("c", 3), ("b", 4), ("b", 5), ("a", 1), (None, 2)]
    dated = df.withColumn("d", F.expr("date_add(date'2024-01-01', n)"))
    assert [r["n"] for r in R.nest(G.group_by(dated, "g"), order_by=[desc("d")]).first()["data"]] == [5, 4, 3, 2, 1]


def test_added_row_leaves_the_frame_alone(spark):
    from tessera.operators import bind as B

    df = spark.range(3)
    assert rows(B.add_row(df, [None])) == [(0,), (1,), (2,), (None,)]
    assert df.schema["id"].nullable is False


def test_complete_is_not_sorted(spark, people):
    plan = R.complete(people, "year", "person")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan


def test_archives_streams_and_urls(spark, tmp_path):
    import http.server
    import threading
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inner.csv", "a,b\n1,x\n")
    assert rows(delim.read_csv(spark, str(tmp_path / "z.zip"))) == [(1, "x")]
    assert rows(delim.read_stream(spark, (tmp_path / "z.zip").read_bytes())) == [(1, "x")]
    assert rows(delim.read_stream(spark, io.StringIO("a;b\n2;y\n"), ";")) == [(2, "y")]
    assert rows(delim.read_stream(spark, b"a\n3\n")) == [(3,)]
    (tmp_path / "u.csv").write_text("a,b\n4,z\n")
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert rows(delim.read_csv(spark, f"http://127.0.0.1:{server.server_port}/u.csv?x=1")) == [(4, "z")]
        assert rows(delim.read_csv(spark, f"http://127.0.0.1:{server.server_port}/z.zip")) == [(1, "x")]
    finally:
        server.shutdown()


def test_arrow_files_are_read_by_executors(spark, tmp_path):
    import pyarrow as pa

    for k in range(3):
        table = pa.table({"a": pa.array([k, None], pa.int8()), "b": [f"x{k}", "y"], "c": pa.array([1.5, None], pa.float32())})
        with pa.OSFile(str(tmp_path / f"{k}.arrow"), "wb") as f, (pa.ipc.new_file if k else pa.ipc.new_stream)(f, table.schema) as w:
            w.write_table(table)
            w.write_table(table)
    got = arrow_io.read_arrow(spark, str(tmp_path))
    assert got.dtypes == [("a", "int"), ("b", "string"), ("c", "double")] and got.count() == 12 and got.rdd.getNumPartitions() >= 1
    assert got.where("a = 2").count() == 2
    arrow_io.write_arrow(got, str(tmp_path / "out" / "one.arrow"))
    assert rows(arrow_io.read_arrow(spark, str(tmp_path / "out" / "one.arrow"))) == rows(got)


def test_database(spark, tmp_path):
    """Derby comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    src = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"), (F.col("id") / 4).cast("decimal(9,2)").alias("PRICE"))
    src.write.format("jdbc").options(url=url, driver=driver, dbtable="CARS").save()
    got = jdbc.read_jdbc(spark, url, "CARS", driver=driver, partition=("ID", 0, 100, 4))
    assert dict(got.dtypes)["PRICE"] == "double" and got.rdd.getNumPartitions() == 4
    assert rows(got.select("ID", "NAME", "PRICE")) == rows(src.select("ID", "NAME", F.col("PRICE").cast("double")))
    some = jdbc.read_jdbc(spark, url, "SELECT ID, NAME FROM CARS WHERE ID < 10", driver=driver).where("ID > 5")
    assert sorted(r["ID"] for r in some.collect()) == [6, 7, 8, 9]
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,5)]" in some._jdf.queryExecution().executedPlan().toString()
