"""Readers, writers, charts and streams."""

import json

import pytest

from tidemark import plot
from tidemark.frame import Frame
from tidemark.sources import readers, xlsx
from tidemark.streaming import read_stream, write_stream


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,age,city\nJohn,30,"New York, NY"\nAlice,,LA\n"Q ""x""",35,\n')
    f = readers.read_csv(spark, str(p))
    assert f.columns == ["name", "age", "city"] and f.collect() == [("John", "30", "New York, NY"), ("Alice", "", "LA"), ('Q "x"', "35", "")] and set(f.dtypes().values()) == {"string"}
    p.write_text("a,b\n")
    assert len(readers.read_csv(spark, str(p))) == 0
    p.write_text("a,b,c\n1,2\n4,5,6\n7,8,9,10\n,,\n")
    assert readers.read_csv(spark, str(p)).select("a").collect() == [("4",), ("",)]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "empty.csv"))


def test_csv_typed(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("name,age,active,score\nJohn,30abc,true,95.5\nAlice,x,0,8e1kg\nBob,-35,yes,\n")
    f = readers.read_csv_typed(spark, str(p), {"age": "int", "active": "bool", "score": "float", "other": "int"})
    assert f.collect() == [("John", 30, True, 95.5), ("Alice", None, False, 80.0), ("Bob", -35, None, None)]


def test_json(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"name":"Alice","age":30},{"name":"Bob"}]')
    f = readers.read_json(spark, str(p))
    assert f.columns == ["age", "name"] and f.collect() == [(30.0, "Alice"), (None, "Bob")]
    assert json.loads(f.to_json()) == [{"age": 30.0, "name": "Alice"}, {"age": None, "name": "Bob"}]
    p.write_text("[]")
    with pytest.raises(ValueError):
        readers.read_json(spark, str(p))


def test_excel(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    f = Frame.from_columns(spark, {"Name": ["Alice", None, "<&>"], "Age": [30, 25, None]})
    f.to_excel(p, "People")
    assert readers.read_excel(spark, p).collect() == [("Alice", "30"), ("", "25"), ("<&>", "")] and readers.read_excel(spark, p, "People").columns == ["Name", "Age"]
    with pytest.raises(KeyError):
        readers.read_excel(spark, p, "nope")
    xlsx.write(p, "S", ["h"] * 30, [])
    assert len(readers.xlsx.read(p)[0]) == 30


def test_parquet(spark, tmp_path):
    p = str(tmp_path / "t")
    f = Frame.from_columns(spark, {"name": ["Alice", "Bob"], "age": [30, None], "score": [9.5, 8.0], "active": [True, False]})
    f.to_parquet(p)
    assert readers.read_parquet(spark, p).collect() == f.collect()
    f.to_parquet(p, "zero")
    g = readers.read_parquet(spark, p)
    assert g.columns == ["active", "age", "name", "score"] and g.collect()[1][1] == 0
    spark.sql("SELECT CAST(1 AS INT) a, CAST(1.5 AS FLOAT) b").write.parquet(p + "2")
    assert readers.read_parquet(spark, p + "2").dtypes() == {"a": "int64", "b": "float64"}
    with pytest.raises(ValueError):
        f.to_parquet(p, "other")


def test_csv_out(spark, tmp_path):
    f = Frame.from_columns(spark, {"a": [1, None], "b": ["x,y", 'q"']})
    assert f.to_csv() == 'a,b\n1,"x,y"\n,"q"""\n' and f.to_csv(sep=";").startswith("a;b\n1;x,y")
    f.to_csv(str(tmp_path / "out"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "out")).collect()) == [("", 'q"'), ("1", "x,y")]


def test_sql(spark):
    Frame.from_columns(spark, {"id": [1, 2], "name": ["Alice", "Bob"]}).to_spark().createOrReplaceTempView("users")
    assert readers.read_sql(spark, "SELECT name FROM users WHERE id = 2").collect() == [("Bob",)]
    config = {"driver": "sqlserver", "server": "db", "port": 1433, "database": "d", "username": "u", "password": "p"}
    assert readers.jdbc_options("SELECT 1", config) == {"url": "jdbc:sqlserver://db:1433;databaseName=d", "user": "u", "password": "p", "query": "SELECT 1"}
    assert readers.jdbc_url("postgres", "db", 5432, "d") == "jdbc:postgresql://db:5432/d?sslmode=disable"
    assert readers.jdbc_options("SELECT 1", config | {"partition_column": "id", "lower": 0, "upper": 9, "partitions": 3})["dbtable"] == "(SELECT 1) q"
    assert readers.bigquery_options("SELECT 1", "p")["parentProject"] == "p"
    with pytest.raises(ValueError):
        readers.bigquery_options("", "p")


def test_charts(spark, tmp_path):
    f = Frame.from_columns(spark, {"x": ["a", "b", "c", None], "v": [1.0, 2.5, None, 4.0], "w": [3, 2, 1, 0]})
    at = lambda n: str(tmp_path / f"{n}.html")
    f.plot_bar("x", "v", output_path=at("bar"), title="<T>")
    f.plot_pie("x", "v", output_path=at("pie"))
    f.plot_line("x", ["v", "w"], output_path=at("line"), theme="dark")
    f.plot_scatter("v", "w", output_path=at("scatter"))
    f.plot_histogram("w", 2, output_path=at("histogram"))
    f.select("v", "w").corr().plot_heatmap(output_path=at("heatmap"))
    read = lambda n: (tmp_path / f"{n}.html").read_text()
    assert "&lt;T&gt;" in read("bar") and read("bar").count("<rect") == 2 and read("pie").count("<path") == 2 and read("scatter").count("<circle") == 3 and read("histogram").count("<rect") == 2 and read("heatmap").count("<rect") == 4 and "#1b1e23" in read("line")
    assert [tuple(r) for r in plot.histogram_bins(f, "w", 3).orderBy("bin").collect()] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (2, 2.0, 3.0, 2)]
    assert plot.histogram_bins(Frame.from_columns(spark, {"k": [5, 5]}), "k").count() == 1
    for bad in (lambda: f.plot_bar("x", "v"), lambda: f.plot_line("x", [], output_path=at("z")), lambda: f.where("w > 9").plot_bar("x", "v", output_path=at("z"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        f.plot_bar("v", "x", output_path=at("z"))


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).selectExpr("id", "double(id * 2) AS v").write.parquet(src)
    f = read_stream(spark, src, "id long, v double").filter("id", ">", 6)
    f = f.assign("w", f.add_scalar("v", 1))
    write_stream(f.select("id", "w"), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(7, 15.0), (8, 17.0), (9, 19.0)]


def test_csv_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,"long\nname"\n1,"a\nb"\n2,c\n3,"x\ny, z"\n4\n5,"d\r\n\n""e"""\n', newline="")
    f = readers.read_csv(spark, str(p))
    assert f.columns == ["id", "long\nname"] and f.collect() == [("1", "a\nb"), ("2", "c"), ("3", "x\ny, z"), ("5", 'd\r\n\n"e"')]
    assert readers.read_csv_typed(spark, str(p), {"id": "int"}).collect()[2] == (3, "x\ny, z")
    g = Frame.from_columns(spark, {"id": ["1", "2", "3"], "text": ["a\nb", "c\r\nd", '\n"e",\n']})
    g.to_csv(str(tmp_path / "out"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "out")).collect()) == g.collect()
