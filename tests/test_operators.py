"""Joins, aggregation, statistics, windows, sorting, concatenation, reshaping."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.frame import Frame
from tidemark.operators.concat import concat


def make(spark, **columns):
    return Frame.from_columns(spark, columns)


def rows(f):
    return sorted(f.collect(), key=str)


def test_merge(spark):
    a, b = make(spark, ID=[1, 2, 3, None], Name=["Alice", "Bob", "Charlie", "nobody"]), make(spark, ID=[1, 2, 4, None], Age=[25, 30, 35, 99])
    assert rows(a.merge(b, "ID")) == [(1, "Alice", 25), (2, "Bob", 30)]
    assert set(a.merge(b, "ID", "full").collect()) == {(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", None), (4, None, 35), (None, "nobody", None), (None, None, 99)}
    assert set(a.merge(b, "ID", "left").collect()) == {(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", None), (None, "nobody", None)}
    assert set(a.merge(b, "ID", "right").collect()) == {(1, "Alice", 25), (2, "Bob", 30), (4, None, 35), (None, None, 99)}
    with pytest.raises(TypeError):
        a.merge(b.astype("ID", "float"), "ID")
    with pytest.raises(ValueError):
        a.merge(b, "ID", "outer")
    with pytest.raises(KeyError):
        a.merge(b, "Age")
    clash = make(spark, ID=[1], Name=["x"])
    with pytest.raises(ValueError):
        a.merge(clash, "ID")
    assert a.merge(clash, "ID", suffixes=("_l", "_r")).columns == ["ID", "Name_l", "Name_r"]


def test_merge_on(spark):
    a, b = make(spark, year=[2020, 2020, 2021], region=["N", "S", "N"], sales=[10, 20, 30]), make(spark, year=[2020, 2021], region=["N", "N"], target=[100, 300])
    assert rows(a.merge_on(b, ["year", "region"])) == [(2020, "N", 10, 100), (2021, "N", 30, 300)]
    out = a.merge_on(b, ["year", "region"], "left")
    assert len(out) == 3 and out.columns == ["year", "region", "sales", "target"]


def test_group(spark):
    f = make(spark, A=["foo", "bar"] * 3 + ["foo", "foo"], B=["one", "one", "two", "three", "two", "two", "one", "three"], C=[float(i) for i in range(1, 9)], D=[10 * i for i in range(1, 9)])
    assert f.group_by("A").mean().collect() == [("bar", None, 4.0, 40.0), ("foo", None, 4.8, 48.0)]
    g = make(spark, A=["foo", "bar", "foo", None], C=[1.0, 2.0, 3.0, None])
    assert g.group_by(["A"]).sum().collect() == [("bar", 2.0), ("foo", 4.0), (None, 0.0)] and g.group_by("A").min().collect()[2] == (None, None) and g.group_by("A").max().collect()[1] == ("foo", 3.0)
    assert g.group_by("A").apply(lambda d: d.head(1) if d.A[0] == "foo" else None, "A string, C double").collect() == [("foo", 1.0)]
    assert g.where("A IS NOT NULL").group_by("A").head(1).collect() == [("foo", 1.0), ("bar", 2.0)]
    for bad in (lambda: g.group_by("A", axis=1), lambda: g.group_by([]), lambda: g.group_by("A").agg({}), lambda: g.group_by("A").agg({"C": ["nope"]})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        g.group_by("A").agg({"X": ["sum"]})


def test_agg(spark):
    f = make(spark, Dept=["Eng", "Sales", "Eng", "Sales", "Eng"], Salary=[100.0, 50.0, 200.0, 70.0, 150.0], Name=list("abcde"))
    out = f.group_by("Dept").agg({"Salary": ["sum", "mean", "max"], "Name": ["count", "first", "last"]})
    assert out.columns == ["Dept", "Salary_sum", "Salary_mean", "Salary_max", "Name_count", "Name_first", "Name_last"]
    assert out.collect()[0] == ("Eng", 450.0, 150.0, 200.0, 3, "a", "e")
    one = f.group_by("Dept").agg({"Salary": ["std", "median", "min"]}).collect()
    assert one[0] == ("Eng", 50.0, 150.0, 100.0)
    keys = make(spark, a=["a_b", "a"], b=["c", "b_c"], v=[1, 2]).group_by(["a", "b"]).agg({"v": "sum"})
    assert len(keys) == 2


def test_describe(spark):
    f = make(spark, Name=list("abcd"), Score=[10.0, 20.0, 30.0, 40.0], Age=[1, 2, 3, 4])
    out = {r[0]: r[1:] for r in f.describe().collect()}
    assert list(out) == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert out["count"] == (4.0, 4.0) and out["mean"][0] == 25 and out["50%"][0] == 25 and out["std"][0] == 12.909944487358056 and out["25%"][0] == 17.5
    assert f.mean() == {"Score": 25.0, "Age": 2.5} and f.sum()["Age"] == 10.0 and f.median()["Age"] == 2.5 and f.min()["Age"] == 1.0 and f.max()["Score"] == 40.0
    assert make(spark, a=[1.0]).std() == {"a": None}
    with pytest.raises(ValueError):
        f.select("Name").describe()


def test_corr(spark):
    f = make(spark, x=[1.0, 2.0, 3.0, 4.0], y=[2.0, 4.0, 6.0, 8.0], z=[4.0, 3.0, 2.0, 1.0], c=[5.0] * 4, g=[1.0, None, 2.0, None])
    c = f.corr()
    assert c.index() == ["x", "y", "z", "c", "g"]
    got = c.collect()
    assert got[0][1] == pytest.approx(1) and got[0][2] == pytest.approx(-1) and got[3] == (None,) * 5 and got[0][4] == pytest.approx(1)
    assert make(spark, x=[1.0, 2.0, 3.0]).cov().collect() == [(1.0,)] and make(spark, x=[1.0]).cov().collect() == [(None,)]


def test_counts_unique_duplicates(spark):
    f = make(spark, City=["NYC", "LA", "NYC", None, "LA", None])
    assert f.unique("City").collect() == [("NYC",), ("LA",), (None,)] and f.nunique("City") == 2 and f.value_counts("City").collect() == [("LA", 2), ("NYC", 2)]
    d = make(spark, A=list("xyxxz"), B=[1, 2, 1, 9, 3])
    flags = lambda keep, sub: [r[0] for r in d.duplicated(sub, keep).collect()]
    assert flags("first", ["A"]) == [False, False, True, True, False] and flags("last", ["A"]) == [True, False, True, False, False] and flags("none", ["A"]) == [True, False, True, True, False]
    assert flags("first", None) == [False, False, True, False, False]
    assert d.drop_duplicates(["A"]).collect() == [("x", 1), ("y", 2), ("z", 3)] and d.drop_duplicates(["A"], "last").collect() == [("y", 2), ("x", 9), ("z", 3)] and d.drop_duplicates(["A"], "none").collect() == [("y", 2), ("z", 3)]
    assert len(f.drop_duplicates()) == 3
    with pytest.raises(ValueError):
        d.duplicated(["A"], "middle")


def test_sample(spark):
    f = make(spark, V=[1, 2, 3, 4, 5])
    assert f.sample(3, 42).collect() == f.sample(3, 42).collect() and len({r[0] for r in f.sample(5, 1).collect()}) == 5 and len(f.sample(0)) == 0
    with pytest.raises(ValueError):
        f.sample(10)


def test_windows(spark):
    f = make(spark, V=[1.0, 2.0, 3.0, 4.0, 5.0], S=list("abcde"))
    col = lambda g: [r[0] for r in g.collect()]
    assert col(f.rolling(3).mean()) == [None, None, 2, 3, 4] and col(f.rolling(2).sum()) == [None, 3, 5, 7, 9] and col(f.rolling(2).min()) == [None, 1, 2, 3, 4] and col(f.rolling(2).max()) == [None, 2, 3, 4, 5]
    assert col(f.rolling(2).std())[1] == pytest.approx(math.sqrt(0.5)) and [r[1] for r in f.rolling(2).sum().collect()] == list("abcde")
    assert col(f.cumsum()) == [1, 3, 6, 10, 15] and col(f.cumprod())[4] == 120 and col(f.shift(1)) == [None, 1, 2, 3, 4] and col(f.shift(-2)) == [3, 4, 5, None, None] and col(f.shift(0)) == col(f)
    g = make(spark, V=[3.0, None, 1.0, 5.0])
    assert col(g.cummax()) == [3, None, 3, 5] and col(g.cummin()) == [3, None, 1, 1] and col(g.cumsum()) == [3, None, 4, 9] and col(g.rolling(2).sum()) == [None, None, None, 6]
    with pytest.raises(ValueError):
        f.rolling(0).sum()


@pytest.mark.parametrize(("size", "cases"), [(1, 64), (3, 64), (3, 2), (7, 0)])
def test_bucketed_windows_equal_plain_ones(spark, monkeypatch, size, cases):
    import random

    from tidemark.plans import order

    monkeypatch.setattr(order, "CASES", cases)

    rng = random.Random(size)
    n = 60
    table = spark.createDataFrame([(k * 3, rng.choice([None, float(rng.randint(-9, 9))]), rng.choice([None, "p", "q"])) for k in rng.sample(range(200), n)], "k int, v double, s string").repartition(4)
    f = Frame.from_table(table, ["k"])
    assert f.cumsum(size).collect() == f.cumsum().collect() and f.cummax(size).collect() == f.cummax().collect() and f.cummin(size).collect() == f.cummin().collect()
    assert f.fillna_method("ffill", size).collect() == f.fillna_method("ffill").collect() and f.fillna_method("bfill", size).collect() == f.fillna_method("bfill").collect()
    for k in (1, 4, -5):
        assert f.shift(k, size).collect() == f.shift(k).collect()
    for w in (1, 2, 5):
        assert f.rolling(w, size).sum().collect() == f.rolling(w).sum().collect()
    from tidemark.plans.order import with_position

    assert sorted(r.p for r in with_position(table, ["k"], "p", size).collect()) == list(range(n))
    assert [r.k for r in with_position(table, ["k"], "p", size).orderBy("p").collect()] == sorted(r.k for r in table.collect())
    two = Frame.from_table(table, ["s", "k"])  # nulls last, several keys
    assert [r.k for r in with_position(table, ["s", "k"], "p", size).orderBy("p").collect()] == [r[0] for r in two.collect()]


@pytest.mark.parametrize("accuracy", [10_000, 40, 1])
def test_quantiles_without_all_values_in_a_task(spark, monkeypatch, accuracy):
    """As ``percentile`` gives them, with ties, nulls, NaN, no value and one; brackets that are wide, or miss, too."""
    from pyspark.sql import functions as F

    from tidemark.operators import statistics

    monkeypatch.setattr(statistics, "ACCURACY", accuracy)
    table = spark.range(3001).repartition(5).selectExpr("hash(id) AS a", "pmod(hash(id), 3) AS b", "IF(id % 3 = 0, NULL, id * 0.37D) AS c", "IF(id % 4 = 0, double('NaN'), -id / 3D) AS d", "CAST(NULL AS DOUBLE) AS e", "IF(id = 7, 2.5D, NULL) AS f", "IF(id < 2990, 0D, id * 1D) AS g").localCheckpoint()
    f, at = Frame.from_table(table), [0.25, 0.5, 0.75]
    out = statistics.quantiles(f, f.columns, at)
    assert "percentile(" not in f.describe().sdf._jdf.queryExecution().toString()
    want = table.agg(*[F.percentile(F.col(c).cast("double"), at) for c in table.columns]).first()
    got = out.first().asDict()
    show = lambda v: v if v is None else repr(v)
    for i in range(len(table.columns)):
        assert [show(got[f"q{i}_{j}"]) for j in range(3)] == [None if want[i] is None else show(want[i][j]) for j in range(3)], table.columns[i]
    empty = statistics.quantiles(f.where("a IS NULL"), ["a"], at).first()
    assert list(empty) == [None, None, None]


def test_thousands_of_splitters_stay_a_small_plan(spark):
    """A plan node a splitter made planning take minutes at some thousand buckets."""
    from tidemark.plans import order

    table = spark.range(0, 9000, 3).repartition(4).selectExpr("id", "hash(id) % 100 AS v", "IF(id % 5 = 0, NULL, CAST(id % 7 AS STRING)) AS s", "CAST(id AS DECIMAL(9, 2)) / 10 AS n", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id) AS at").localCheckpoint()
    for keys in (["id"], ["s", "n"], ["at"]):
        cuts = order.splitters(table, keys, 2)
        parted = order.bucketed(table, keys, cuts)
        assert len(cuts) > 1000 and parted._jdf.queryExecution().analyzed().toString().count("named_struct") < 50
        rows = parted.orderBy(*[parted[k].asc_nulls_last() for k in keys]).collect()
        assert [r[order.BUCKET] for r in rows] == sorted(r[order.BUCKET] for r in rows) and len({r[order.BUCKET] for r in rows}) > 1000
    f = Frame.from_table(table.select("id", "v"), ["id"])
    assert f.cumsum(2).collect() == f.cumsum().collect()


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("up", [True, False])
def test_sort_keys_of_every_kind(spark, up, last):
    """Sorted rows against Spark's own sort; positions over many buckets against both."""
    from pyspark.sql import functions as F

    from tidemark.plans.order import with_position

    columns = {
        "b": "tinyint(-128), tinyint(127), tinyint(0)", "l": "-9223372036854775808, 9223372036854775807, 0L", "d": "double('NaN'), double('-Infinity'), -0.0D, 0.5D, double('Infinity')", "f": "float('NaN'), float(-1)",
        "s": "'', 'a', 'ab', 'b', 'é', 'Z', '\\u0000', '日本'", "x": "X'', X'00', X'0001', X'FF'", "t": "true, false", "n": "1.10BD, -2.50BD, 0.00BD", "day": "DATE'1960-01-01', DATE'2024-02-29'", "at": "TIMESTAMP'1969-12-31 23:59:59.999999', TIMESTAMP'2024-03-31 02:30:00.5'", "ntz": "TIMESTAMP_NTZ'1960-01-01 00:00:00.000001', TIMESTAMP_NTZ'2024-10-27 02:30:00'",
    }
    rows = spark.range(60).repartition(3)
    for i, (name, values) in enumerate(columns.items()):
        rows = rows.withColumn(name, F.expr(f"element_at(array({values}, NULL), CAST(pmod(hash(id, {i}), size(array({values}, NULL))) AS INT) + 1)"))
    rows = rows.localCheckpoint()
    f = Frame.from_table(rows, ["id"])
    for name in columns:
        c = F.col(name)
        key = (c.asc_nulls_last() if last else c.asc_nulls_first()) if up else (c.desc_nulls_last() if last else c.desc_nulls_first())
        want = [r[0] for r in rows.orderBy(key, "id").collect()]
        g = f.sort_values(name, up, "last" if last else "first")
        assert [r[0] for r in g.to_spark().select("id").collect()] == want, name
        if name in ("d", "s"):
            assert [r[0] for r in with_position(g.sdf, g.order, "p", 20).orderBy("p").collect()] == want, name


def test_order_of_a_sort_is_made_of_values(spark):
    """Row numbers of a sorted plan change from one evaluation to the next, and positions of many rows evaluate it more than once."""
    from pyspark.sql import functions as F

    f = Frame.from_table(spark.range(2000).repartition(4).withColumn("v", F.expr("id % 7")), ["id"])
    for g in (f.sort_values("v", False), f.set_index("v").sort_index(False)):
        assert "monotonically_increasing_id" not in g.sdf._jdf.queryExecution().toString()
    again = f.sort_values("v", False, ignore_index=True).filter("v", "<", 5)
    again = again.with_positions()[0].sort_values("id").sort_values("v")
    assert [r[1] for r in again.collect()] == sorted(r[1] for r in f.collect() if r[1] < 5) and again.head(2).index() == ["1714", "1715"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joined_sorts_have_one_position_a_row(spark, monkeypatch, how):
    """Positions over many buckets, where each bucket's rows and the rows before it come from two evaluations of the plan."""
    from pyspark.sql import functions as F

    from tidemark.plans import order

    left = Frame.from_table(spark.range(3000).repartition(5).selectExpr("id AS a", "id % 97 AS k", "hash(id) % 1000 AS v"), ["a"]).sort_values("v", False)
    right = Frame.from_table(spark.range(80, 120).selectExpr("id AS k", "id AS b", "hash(id) % 5 AS w"), ["b"]).sort_values("w")
    joined = left.merge_on(right, ["k"], how)
    plain = joined.collect()
    out = order.with_position(joined.sdf, joined.order, "p", 100)
    assert sorted(r.p for r in out.select("p").collect()) == list(range(len(plain)))
    assert [tuple(r) for r in out.orderBy("p").select(*[F.col(c) for c in joined.columns]).collect()] == plain


def test_sort(spark):
    f = make(spark, Name=["Charlie", None, "Alice", "Bob"], Score=[85.0, 70.0, 95.0, None])
    assert [r[1] for r in f.sort_values("Score").collect()] == [70, 85, 95, None] and [r[1] for r in f.sort_values("Score", False).collect()] == [95, 85, 70, None]
    assert [r[1] for r in f.sort_values("Score", False, "first").collect()] == [None, 95, 85, 70]
    s = make(spark, Dept=["A", "A", "A", "B"], Name=["First", "Second", "Third", "Only"])
    assert [r[1] for r in s.sort_values(["Dept"]).collect()] == ["First", "Second", "Third", "Only"] and [r[1] for r in s.sort_values(["Dept"], [False]).collect()] == ["Only", "First", "Second", "Third"]
    assert f.sort_values("Score").index() == ["1", "0", "2", "3"] and f.sort_values("Score", ignore_index=True).index() == ["0", "1", "2", "3"]
    big = make(spark, Value=list(range(1000, 0, -1)))
    assert [r[0] for r in big.sort_values("Value").head(3).collect()] == [1, 2, 3] and [r[0] for r in big.topk("Value", 2).collect()] and len(big.topk(["Value"], 5)) == 5
    with pytest.raises(KeyError):
        f.sort_values("nope")
    with pytest.raises(ValueError):
        f.sort_values(["Name", "Score"], [True, False, True])


def test_concat(spark):
    a, b = make(spark, A=[1, 2], B=["x", "y"]), make(spark, A=[3, 4], B=["z", "w"])
    assert concat([a, None, b]).collect() == [(1, "x"), (2, "y"), (3, "z"), (4, "w")] and concat([a]) is a
    c = make(spark, A=["s"], C=[1.5])
    assert concat([a, c]).collect() == [("1", "x", None), ("2", "y", None), ("s", None, 1.5)] and concat([a, c], join="inner").columns == ["A"]
    assert concat([make(spark, b=[1]), make(spark, a=[2])], sort=True).columns == ["a", "b"] and concat([a, b.astype("A", "float")]).collect()[0] == (1.0, "x")
    for bad in (lambda: concat([]), lambda: concat([None]), lambda: concat([make(spark, a=[1]), make(spark, b=[1])], join="inner"), lambda: concat([a, b], axis=1), lambda: concat([a, b], verify_integrity=True), lambda: concat([a, b], axis=2)):
        with pytest.raises(ValueError):
            bad()
    assert concat([a, b], ignore_index=True).index() == ["0", "1", "2", "3"]
    x, y = make(spark, A=[1, 2, 3]), make(spark, B=[4, 5])
    assert len(concat([x, y], axis=1, join="inner")) == 2 and concat([x, y], axis=1).collect() == [(1, 4), (2, 5), (3, None)]
    last = make(spark, B=[7, 8]).set_index(["0", "0"])
    assert concat([x, last], axis=1, join="inner").collect() == [(1, 8)]


def test_pivot(spark):
    f = make(spark, A=["foo", "foo", "foo", "bar", "bar"], B=["one", "one", "two", "one", "two"], C=[1.0, 2.0, 3.0, 4.0, 5.0])
    assert f.pivot_table("A", "B", "C", "sum").collect() == [("bar", 4.0, 5.0), ("foo", 3.0, 3.0)] and f.pivot_table("A", "B", "C").collect()[1] == ("foo", 1.5, 3.0)
    g = make(spark, A=["foo", "foo", "bar"], B=["one", "two", "one"], C=[1.0, 2.0, 3.0], D=[10.0, 20.0, 30.0]).pivot_table(["A"], "B", ["C", "D"], "sum")
    assert g.columns == ["A", "C_one", "C_two", "D_one", "D_two"] and g.collect()[0] == ("bar", 3.0, None, 30.0, None)
    h = make(spark, A=["foo", "bar", "baz"], B=["one", "two", None], C=[1.0, 2.0, 3.0])
    assert h.pivot_table("A", "B", "C", "sum", fill=0.0).collect() == [("bar", 0.0, 2.0), ("baz", 0.0, 0.0), ("foo", 1.0, 0.0)] and h.pivot_table("A", "B", "C", "count").collect()[0] == ("bar", None, 1.0)
    with pytest.raises(ValueError):
        f.pivot_table("A", "B", "C", "median")


def test_melt_stack(spark):
    f = make(spark, Name=["Alice", "Bob"], Math=[90.0, 80.0], Science=[85.0, None])
    assert f.melt(["Name"]).collect() == [("Alice", "Math", 90.0), ("Alice", "Science", 85.0), ("Bob", "Math", 80.0), ("Bob", "Science", None)]
    assert f.melt(["Math"], ["Name", "Science"], "k", "v").collect()[1] == (90.0, "Science", "85.0")
    with pytest.raises(ValueError):
        f.melt(["Name", "Math", "Science"])
    s = f.set_index("Name").drop(columns=["Name"]).stack()
    assert s.collect() == [("Alice", "Math", 90.0), ("Alice", "Science", 85.0), ("Bob", "Math", 80.0)]
    u = s.unstack()
    assert u.columns == ["Math", "Science"] and u.collect() == [(90.0, 85.0), (80.0, None)] and u.index() == ["Alice", "Bob"]
    again = concat([s, make(spark, index=["Alice"], variable=["Math"], value=[1.0])], ignore_index=True).unstack()
    assert again.collect()[0] == (1.0, 85.0)


def test_plans_push_down(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(str(tmp_path / "t"))
    f = Frame.from_table(spark.read.parquet(str(tmp_path / "t")), ["a"]).filter("b", ">", 10).group_by("c").agg({"b": "sum"})
    plan = f.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,10)" in plan and "ReadSchema: struct<b:bigint,c:string>" in plan and "partial_sum" in plan
