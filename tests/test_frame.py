"""Frames: construction, columns, labels, places, filters, arithmetic, casts."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.frame import Frame


def make(spark, **columns):
    return Frame.from_columns(spark, columns)


@pytest.fixture
def people(spark):
    return make(spark, name=["Alice", "Bob", "Charlie", "David"], age=["25", "30", "35", "28"], city=["NYC", "LA", "SF", "Seattle"])


def test_construction(spark):
    f = Frame.from_rows(spark, ["a", "b"], [[1, None], ["x", "y"]], {"a": "int", "b": "string"})
    assert f.collect() == [(1, "x"), (None, "y")]
    assert f.dtypes() == {"a": "int64", "b": "string"}
    for bad in (([], [], {}), (["a"], [[1], [2]], {"a": "int"}), (["a", "b"], [[1], [1, 2]], {"a": "int", "b": "int"}), (["a"], [[1]], {}), (["a"], [[1]], None)):
        with pytest.raises(ValueError):
            Frame.from_rows(spark, *bad)
    with pytest.raises(TypeError):
        Frame.from_rows(spark, ["a"], [[1]], {"a": "float"})
    empty = Frame.empty(spark, ["a", "b"], {"a": "int"})
    assert len(empty) == 0 and empty.dtypes() == {"a": "int64", "b": "string"}


def test_inference(spark):
    f = make(spark, a=[1, 2.5], b=[1, "x"], c=[None, None], d=[True, None])
    assert f.dtypes() == {"a": "float64", "b": "string", "c": "string", "d": "bool"}
    assert f.collect() == [(1.0, "1", None, True), (2.5, "x", None, None)]


def test_projection(people):
    assert people.select("city", "name").columns == ["city", "name"]
    with pytest.raises(KeyError):
        people.select("nope")
    with pytest.raises(ValueError):
        people.select()
    swapped = people.rename({"name": "age", "age": "name"})
    assert swapped.columns == ["age", "name", "city"] and swapped.collect()[0] == ("Alice", "25", "NYC")
    for bad in ({}, {"nope": "x"}, {"name": "age"}):
        with pytest.raises((ValueError, KeyError)):
            people.rename(bad)
    assert people.drop(columns=["age"]).columns == ["name", "city"]
    assert people.drop(columns=["nope"], errors="ignore").columns == people.columns
    assert people.drop(labels=["age"], axis=1).columns == ["name", "city"]
    with pytest.raises(KeyError):
        people.drop(columns=["nope"])
    assert [r[0] for r in people.drop(index=["1", "3"]).collect()] == ["Alice", "Charlie"]
    with pytest.raises(KeyError):
        people.drop(index=["9"])
    assert [r[0] for r in people.drop(labels=["0"]).collect()] == ["Bob", "Charlie", "David"]


def test_order_key_that_is_projected_away(spark):
    f = Frame.from_table(spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, v string"), ["k"])
    assert f.select("v").collect() == [("a",), ("b",), ("c",)]
    assert f.rename({"k": "key"}).tail(2).collect() == [(2, "b"), (3, "c")]
    assert f.assign("k", F.lit(0)).collect() == [(0, "a"), (0, "b"), (0, "c")]


def test_columns(people):
    f = people.assign("age", F.col("age").cast("bigint")).assign("next", F.col("age") + 1)
    assert [r[3] for r in f.collect()] == [26, 31, 36, 29]
    assert people.insert(1, "x", F.lit(1)).columns == ["name", "x", "age", "city"]
    for bad in ((9, "x"), (0, "age")):
        with pytest.raises((IndexError, ValueError)):
            people.insert(*bad, F.lit(1))
    assert [r[3] for r in people.assign_func("tag", lambda r: r["name"][0] + r["city"][0]).collect()] == ["AN", "BL", "CS", "DS"]
    assert people.pipe(lambda f: f.head(1)).collect()[0][0] == "Alice"


def test_head_tail_slice(people):
    names = lambda f: [r[0] for r in f.collect()]
    assert names(people.head(2)) == ["Alice", "Bob"] and names(people.head()) == names(people) and names(people.head(-3)) == []
    assert names(people.tail(2)) == ["Charlie", "David"]
    assert names(people.slice([3, 0, 3])) == ["David", "Alice", "David"]
    with pytest.raises(IndexError):
        people.slice([4])


def test_labels(people):
    f = people.set_index(["a", "b", "a", "c"])
    assert f.index() == ["a", "b", "a", "c"] and people.index() == ["0", "1", "2", "3"]
    assert f.loc.at("a", "name") == "Alice" and not f.loc.is_null_at("a", "name")
    assert [r[0] for r in f.loc.rows(["c", "a", "c"]).collect()] == ["David", "Alice", "David"]
    assert f.loc.row("b").collect() == [("Bob", "30", "LA")]
    assert f.loc.cols(["age"]).columns == ["age"]
    for bad in (lambda: f.loc.at("z", "name"), lambda: f.loc.rows(["z"]), lambda: f.loc.row("z")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        people.set_index(["a"])
    assert [r[0] for r in f.drop(index=["a"]).collect()] == ["Bob", "David"]
    assert f.reset_index().index() == ["0", "1", "2", "3"]
    assert f.sort_index().index() == ["a", "a", "b", "c"]
    assert [r[0] for r in f.sort_index(False).collect()] == ["David", "Bob", "Alice", "Charlie"]


def test_labels_follow_their_rows(spark):
    f = make(spark, v=[5, 3, None, 4, 3], w=list("abcde"))
    assert f.filter("v", ">", 3).index() == ["0", "3"] and f.filter("v", ">", 3).select("w").filter("w", "!=", "a").index() == ["3"]
    assert f.dropna().sort_values("v").index() == ["1", "4", "3", "0"] and f.sort_values("v", False).head(2).index() == ["0", "3"]
    assert f.tail(2).index() == ["3", "4"] and f.slice([4, 0, 4]).index() == ["4", "0", "4"] and f.iloc.range(1, 3).index() == ["1", "2"]
    assert f.drop_duplicates(["v"], "last").index() == ["0", "2", "3", "4"] and f.sort_values("v").tail(2).rename({"v": "x"}).loc.at("2", "w") == "c"
    assert sorted(f.sample(5, 3).index()) == list("01234") and f.sample(2, 3).index() == f.sample(5, 3).head(2).index()
    assert f.filter("v", ">", 3).reset_index().index() == ["0", "1"] and f.sort_values("v").sort_index().collect() == f.collect() and f.sort_values("w", False).sort_values("v").index() == ["4", "1", "3", "0", "2"]
    assert f.shift(1).filter("w", "==", "a").index() == ["1"] and f.filter("v", ">", 3).cumsum().index() == ["0", "3"] and f.filter("v", ">", 3).rolling(1).sum().drop(index=["0"]).collect() == [(4.0, "d")]
    t = Frame.from_table(spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "k int, w string"), ["k"])
    assert t.where("w != 'a'").select("w").index() == ["1", "2"] and t.sort_values("w", False).slice([0]).index() == ["2"] and t.tail(1).tail(1).index() == ["2"]
    from tidemark.operators.concat import concat

    assert concat([f.head(2), f.head(3)]).index() == ["0", "1", "0", "1", "2"] and concat([f.head(2), f.tail(1)]).index() == ["0", "1", "4"] and concat([f.head(1), f.head(1)]).filter("v", ">", 0).index() == ["0", "0"]


def test_multi_index(spark):
    f = make(spark, Country=["USA", "USA", None], City=["NYC", "LA", "London"], Pop=[1, 2, 3]).set_multi_index(["Country", "City"])
    assert f.index() == ["USA_NYC", "USA_LA", "null_London"]


def test_iloc(people):
    assert people.iloc.at(1, 2) == "LA" and people.iloc.row(2).collect()[0][0] == "Charlie"
    assert [r[0] for r in people.iloc.range(1, 3).collect()] == ["Bob", "Charlie"]
    assert people.iloc.range(2, 2).collect() == []
    assert people.iloc.cols([2, 0]).columns == ["city", "name"]
    for bad in (lambda: people.iloc.at(4, 0), lambda: people.iloc.at(-1, 0), lambda: people.iloc.at(0, 3), lambda: people.iloc.range(0, 5), lambda: people.iloc.rows([4])):
        with pytest.raises(IndexError):
            bad()


def test_filter(spark):
    f = make(spark, Name=["Alice", "Bob", "Charlie", "Diana", None], Age=[30, 25, 35, 28, None], City=["NYC", "LA", "NYC", "SF", None])
    assert [r[0] for r in f.filter("Age", ">", 28).collect()] == ["Alice", "Charlie"]
    assert len(f.filter("Age", ">=", 30.0)) == 2 and len(f.filter("City", "==", "NYC")) == 2
    assert [r[0] for r in f.filter("City", "!=", "NYC").filter("Age", "<", 28).result().collect()] == ["Bob"]
    assert len(f.where(lambda r: r["Age"] is None)) == 1 and len(f.where("Age BETWEEN 25 AND 30")) == 3
    with pytest.raises(KeyError):
        f.filter("nope", "==", 1)
    with pytest.raises(ValueError):
        f.filter("Age", "~", 1)
    with pytest.raises(TypeError):
        f.filter("Age", "==", "x")


def test_arithmetic(spark):
    f = make(spark, A=[10, 20, 30, None, 7], B=[2, 4, 5, 1, 0], C=[1.5, -1.0, 0.0, 2.0, float("nan")])
    get = lambda c: [r[0] for r in f.assign("out", c).select("out").collect()]
    assert get(f.add("A", "B")) == [12, 24, 35, None, 7] and f.assign("out", f.add("A", "B")).dtypes()["out"] == "int64"
    assert get(f.div("A", "B"))[:4] == [5.0, 5.0, 6.0, None] and get(f.div("A", "B"))[4] == math.inf
    assert get(f.div("B", "A"))[4] == 0.0
    by_zero = get(f.div_scalar("C", 0))
    assert by_zero[0] == math.inf and by_zero[1] == -math.inf and math.isnan(by_zero[2]) and math.isnan(by_zero[4])
    assert get(f.pow_scalar("B", 2)) == [4.0, 16.0, 25.0, 1.0, 0.0]
    assert get(f.mul_scalar("A", 2.0)) == [20, 40, 60, None, 14] and f.assign("o", f.mul_scalar("A", 2.0)).dtypes()["o"] == "int64"
    assert f.assign("o", f.add_scalar("A", 0.5)).dtypes()["o"] == "float64"
    assert get(f.sub_scalar("A", 1)) == [9, 19, 29, None, 6] and get(f.sub("A", "B"))[0] == 8 and get(f.mul("A", "B"))[0] == 20 and get(f.pow("B", "B"))[0] == 4.0


def test_comparison(spark):
    f = make(spark, A=[1, 2, None], B=[1.0, 1.0, 1.0], S=["a", "b", "c"], T=[True, False, True])
    get = lambda c: [r[0] for r in f.assign("out", c).select("out").collect()]
    assert get(f.eq("A", "B")) == [True, False, None] and get(f.ne("A", "B")) == [False, True, None]
    assert get(f.eq("A", "S")) == [False, False, None] and get(f.ne("A", "S")) == [True, True, None]
    assert get(f.gt("A", "B")) == [False, True, None] and get(f.le_scalar("S", "b")) == [True, True, False]
    assert get(f.eq_scalar("S", 1)) == [False] * 3 and get(f.ge("A", "B")) == [True, True, None] and get(f.lt("A", "B")) == [False, False, None] and get(f.le("A", "B")) == [True, False, None]
    assert get(f.gt_scalar("A", 1)) == [False, True, None] and get(f.lt_scalar("A", 2)) == [True, False, None] and get(f.ge_scalar("A", 2)) == [False, True, None] and get(f.ne_scalar("A", 1)) == [False, True, None]
    for bad in (lambda: f.gt("A", "S"), lambda: f.gt("T", "T")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        f.eq_scalar("A", None)
    with pytest.raises(TypeError):
        f.add("A", "S")


def test_apply_map(spark):
    f = make(spark, A=[1, None, 3], S=["a", "b", None])
    assert [r[0] for r in f.apply("A", lambda v: None if v is None else v * 1.5).collect()] == [1.5, None, 4.5]
    assert [r[1] for r in f.apply("S", F.upper).collect()] == ["A", "B", None]
    assert [r[1] for r in f.map("S", {"a": "x"}).collect()] == ["x", "b", None]
    assert [r[0] for r in f.map("A", {1: "one"}).collect()] == ["one", None, "3"]
    assert [r[0] for r in f.map("A", {1: 0.5}).collect()] == [0.5, None, 3.0]
    rows = f.apply_row(lambda r: {"S": r["S"], "z": r["A"], "b": 1}, {"z": "int", "b": "int", "S": "string"})
    assert rows.columns == ["S", "b", "z"] and rows.collect() == [("a", 1, 1), ("b", 1, None), (None, 1, 3)]


def test_astype(spark):
    f = make(spark, V=["1.5", " 2.0 ", None], I=["10", "3.7", "-3.7"], B=["yes", "F", "1"], X=["a", "1", "2"])
    assert [r[0] for r in f.astype("V", "float").collect()] == [1.5, 2.0, None]
    assert [r[1] for r in f.astype("I", "int").collect()] == [10, 3, -3]
    assert [r[2] for r in f.astype("B", bool).collect()] == [True, False, True]
    assert [r[0] for r in f.astype("V", "float").astype("V", "int").collect()] == [1, 2, None]
    assert [r[2] for r in f.astype("B", "bool").astype("B", "int").astype("B", "bool").collect()] == [True, False, True]
    with pytest.raises(Exception, match="(?i)cast"):
        f.astype("X", "int").collect()
    with pytest.raises(TypeError):
        f.astype("X", "nonsense")


def test_missing(spark):
    f = make(spark, S=[10.0, None, 30.0, None], I=[1, None, 3, 4], N=["a", None, None, "d"], Z=[float("nan"), 1.0, 1.0, 1.0])
    assert [r[0] for r in f.fillna(0).collect()] == [10.0, 0.0, 30.0, 0.0] and f.fillna(0).collect()[1][2] is None
    assert math.isnan(f.fillna(0).collect()[0][3]) and [r[0] for r in f.collect()] == [10.0, None, 30.0, None]
    assert [r[1] for r in f.fillna(2.9).collect()] == [1, 2, 3, 4] and [r[2] for r in f.fillna("-").collect()] == ["a", "-", "-", "d"]
    with pytest.raises(TypeError):
        f.fillna_column("I", "x")
    with pytest.raises(ValueError):
        f.fillna(None)
    assert [r[0] for r in f.fillna_method("ffill").collect()] == [10.0, 10.0, 30.0, 30.0]
    assert [r[0] for r in f.fillna_method("bfill").collect()] == [10.0, 30.0, 30.0, None]
    assert len(f.dropna()) == 1 and len(f.dropna("all", ["S", "N"])) == 3 and len(f.dropna("any", ["I"])) == 3
    assert f.isna().collect()[1] == (True, True, True, False) and f.notna().collect()[1] == (False, False, False, True)
    assert f.null_count() == {"S": 2, "I": 1, "N": 2, "Z": 0}


def test_strings(spark):
    f = make(spark, Name=["Alice", "bob", "  Charlie \t", None, "o'neil of ÉCOLE été"])
    s = f.str("Name")
    get = lambda c: [r[0] for r in f.assign("out", c).select("out").collect()]
    assert get(s.lower())[0] == "alice" and get(s.upper())[1] == "BOB" and get(s.strip())[2] == "Charlie" and get(s.lower())[3] is None
    assert get(s.contains("li"))[:2] == [True, False] and get(s.startswith("A"))[0] and get(s.endswith("b"))[1] and get(s.contains("li"))[3] is None
    assert get(s.replace("li", "LI"))[0] == "ALIce" and get(s.len())[:2] == [5, 3] and get(s.title())[4] == "O'neil Of ÉCOLE Été"
    assert get(s.split("."))[0] == ["Alice"] and get(s.split("li")) [0] == ["A", "ce"] and get(s.split("l"))[3] is None
    with pytest.raises(TypeError):
        make(spark, A=[1]).str("A")


def test_datetimes(spark):
    f = make(spark, d=["2021-01-15", "2022-06-30 13:14:15", "06/30/2022", "2021-01-15T10:00:00+02:00", None]).to_datetime("d")
    d = f.dt("d")
    get = lambda c: [r[0] for r in f.assign("out", c).select("out").collect()]
    assert get(d.year()) == [2021, 2022, 2022, 2021, None] and get(d.month()) == [1, 6, 6, 1, None] and get(d.day())[:2] == [15, 30]
    assert get(d.hour()) == [0, 13, 0, 8, None] and get(d.minute())[1] == 14 and get(d.second())[1] == 15
    assert get(d.weekday())[:2] == [5, 4] and get(d.date())[1] == "2022-06-30"
    assert make(spark, d=["15.01.21 09:05"]).to_datetime("d", "02.01.06 15:04").collect()[0][0].isoformat() == "2021-01-15T09:05:00"
    with pytest.raises(Exception, match="not a date-time"):
        make(spark, d=["not-a-date"]).to_datetime("d").collect()
    with pytest.raises(TypeError):
        make(spark, d=["x"]).dt("d")


def test_categorical(spark):
    f = make(spark, grade=["B", "A", None, "A", "C"])
    assert [r[0] for r in f.categories("grade").collect()] == ["B", "A", "C"]
    assert sorted(f.as_categorical("grade").select("grade_code").collect()) == [(-1,), (0,), (1,), (1,), (2,)]


def test_display(people):
    assert "4 rows x 3 columns" in people.info() and "name  4 non-null  string" in people.info()
    text = str(people.assign("age", F.lit(None).cast("string")))
    assert "| Alice" in text and "null" in text and "[4 rows x 3 columns]" in text
    assert len(people) == 4


def test_series(spark):
    s = make(spark, v=[1, None, 3]).series("v")
    assert len(s) == 3 and s.at(2) == 3 and s.is_null(1) and s.null_count() == 1 and s.dtype() == "int64" and s.mask() == [False, True, False]
    assert s.set(1, 9).values() == [1, 9, 3] and s.set_null(0).values() == [None, None, 3] and s.append(4).append_null().values() == [1, None, 3, 4, None]
    assert s.slice(1, 3).values() == [None, 3]
    with pytest.raises(TypeError):
        s.set(0, "x")
    with pytest.raises(IndexError):
        s.set(3, 1)


def test_set():
    from tidemark.collection import Set

    a, b = Set([1, 2, 3]), Set([2, 3, 4])
    assert sorted(a.union(b)) == [1, 2, 3, 4] and sorted(a.intersect(b)) == [2, 3] and sorted(a.difference(b)) == [1] and sorted(a.filter(lambda v: v > 1)) == [2, 3]
    assert a.compare(Set([3, 2, 1])) == (True, None) and not a.compare(b)[0] and a.has(1) and 4 not in a and sorted(Set.of_keys({"x": 1})) == ["x"]
    with pytest.raises(ValueError):
        a.add_multi(5, 1)
    assert sorted(a.to_list()) == [1, 2, 3, 5] and len(a) == 4


def test_assign_func_infers_from_all_rows(spark):
    f = Frame.from_table(spark.range(300).withColumnRenamed("id", "n"), order_by=["n"])
    late = lambda r: None if r["n"] < 150 else 2.7 if r["n"] == 299 else 1
    assert [r[1] for r in f.assign_func("x", late).collect()][148:] == [None, None] + [1.0] * 149 + [2.7]
    assert f.assign_func("x", lambda r: 1).dtypes()["x"] == f.dtypes()["n"]
