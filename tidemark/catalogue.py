"""Queries of the driver contract, one or more per operator, each with the SQL
that states the same result over the same tables.

Nulls are injected alike on both sides, floats are rounded, and orders are made
visible as a column ``rn``, since rows are compared without their order.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plot
from .frame import Frame
from .operators.concat import concat
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "lineitem": [],
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame.from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])


def _query(sql: str | None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__.lstrip("_")
        QUERIES[key] = lambda spark, sf_dir: (lambda out: out.to_spark() if isinstance(out, Frame) else out)(fn(lambda t: _t(spark, sf_dir, t)))
        if sql:
            ORACLE[key] = sql
        return fn

    return add


def _rn(f: Frame) -> DataFrame:
    """The data with its row number, from 0."""
    f, pos = f._own_order().with_positions()
    return f.sdf.select(F.col(pos).cast("bigint").alias("rn"), *f.columns)


def _shared(t: Frame, tag: str) -> str:
    """A path for a round trip, where executors can write: the session's shared
    folder, or a local one in a local session."""
    spark = t.sdf.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base or tempfile.mkdtemp(prefix='tidemark-')}/{tag}-{uuid.uuid4().hex}"


def _round(f: Frame, digits: int = 4) -> Frame:
    for c in f.columns:
        if f.schema[c].dataType.simpleString() == "double":
            f = f.assign(c, F.round(F.col(f"`{c}`"), digits))
    return f


# ------------------------------------------------------------------- flagship


@_query("""
SELECT r_name, count(o_totalprice) AS o_totalprice_count, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 1000 GROUP BY r_name""")
def revenue_by_region(t):
    orders = t("orders").filter("o_totalprice", ">", 1000.0).rename({"o_custkey": "c_custkey"})
    joined = orders.merge(t("customer").rename({"c_nationkey": "n_nationkey"}), "c_custkey").merge(t("nation").rename({"n_regionkey": "r_regionkey"}), "n_nationkey").merge(t("region"), "r_regionkey")
    out = joined.group_by("r_name").agg({"o_totalprice": ["count", "sum", "mean"]})
    return out.assign("o_totalprice_sum", F.round("o_totalprice_sum", 2)).assign("o_totalprice_mean", F.round("o_totalprice_mean", 4))


# -------------------------------------------------------------------- filters


@_query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag = 'R'")
def filter_chain(t):
    return t("lineitem").filter("l_quantity", ">=", 30.0).filter("l_discount", "<", 0.05).filter("l_returnflag", "==", "R").result().select("l_orderkey", "l_quantity", "l_shipdate")


@_query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'error') <> 'click'")
def filter_ne_nulls(t):
    return t("events").assign("kind", F.expr("nullif(event_type, 'error')")).filter("kind", "!=", "click").select("event_id", "kind")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 5000")
def where_expr(t):
    return t("orders").where("o_orderstatus = 'F' OR o_totalprice < 5000").select("o_orderkey", "o_totalprice")


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%' AND c_custkey % 2 = 0")
def where_callable(t):
    return t("customer").select("c_custkey", "c_mktsegment").where(lambda r: r["c_mktsegment"].startswith("B") and r["c_custkey"] % 2 == 0).select("c_custkey")


# --------------------------------------------------------- projection, columns


@_query("SELECT c_name AS name, c_custkey AS id FROM customer")
def select_rename(t):
    return t("customer").select("c_name", "c_custkey", "c_acctbal").rename({"c_name": "name", "c_custkey": "id"}).drop(columns=["c_acctbal"])


@_query("SELECT c_name AS c_mktsegment, c_mktsegment AS c_name FROM customer")
def rename_swap(t):
    return t("customer").select("c_name", "c_mktsegment").rename({"c_name": "c_mktsegment", "c_mktsegment": "c_name"})


@_query("SELECT p_partkey, round(p_retailprice * 1.1, 4) AS gross, p_name FROM part")
def insert_column(t):
    f = t("part").select("p_partkey", "p_name", "p_retailprice")
    return f.insert(1, "gross", F.round(f.mul_scalar("p_retailprice", 1.1), 4)).drop(columns=["p_retailprice"])


@_query("SELECT p_partkey, upper(p_brand) AS p_brand, p_size + 1 AS next_size FROM part")
def assign_expr(t):
    f = t("part").select("p_partkey", "p_brand", "p_size")
    return f.assign("p_brand", f.str("p_brand").upper()).assign("next_size", f.add_scalar("p_size", 1)).drop(columns=["p_size"])


@_query("SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation")
def assign_func(t):
    return t("nation").assign_func("tag", lambda r: f"{r['n_name']}/{r['n_regionkey']}", "string").select("n_nationkey", "tag")


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 3))")
def drop_rows_by_label(t):
    f = t("nation")
    names = [r[1] for r in f.select("n_nationkey", "n_name").where("n_nationkey IN (1, 3)").collect()]
    return f.set_index("n_name").drop(index=names).select("n_nationkey", "n_name")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def head(t):
    return t("orders").select("o_orderkey", "o_totalprice").head(7)


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(t):
    return t("orders").select("o_orderkey", "o_totalprice").tail(7)


@_query("SELECT rn - 10 AS rn, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 10 AND rn < 25")
def iloc_range(t):
    return _rn(t("orders").select("o_orderkey", "o_totalprice").iloc.range(10, 25))


@_query("SELECT i.rn, o_orderkey FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 40)) i(rn, p) JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) o ON o.rn = i.p")
def iloc_rows(t):
    return _rn(t("orders").select("o_orderkey").iloc.rows([5, 3, 5, 40])).withColumn("rn", F.col("rn").cast("int"))


@_query("SELECT i.rn, min(c_custkey) AS c_custkey FROM (VALUES (0, 'BUILDING'), (1, 'MACHINERY')) i(rn, s) JOIN customer ON c_mktsegment = i.s GROUP BY i.rn")
def loc_rows(t):
    f = t("customer").set_index("c_mktsegment").loc.rows(["BUILDING", "MACHINERY"]).select("c_custkey")
    return _rn(f).withColumn("rn", F.col("rn").cast("int"))


@_query("SELECT c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR) AS label, c_custkey FROM customer")
def set_multi_index(t):
    f = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey").set_multi_index(["c_mktsegment", "c_nationkey"], "|")
    return f.sdf.select(F.col("__index").alias("label"), "c_custkey")


@_query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS label, c_custkey FROM customer")
def reset_index(t):
    f = t("customer").set_index("c_name").reset_index().with_labels()
    return f.sdf.select(F.col("__index").alias("label"), "c_custkey")


# ------------------------------------------------------------------ arithmetic


@_query("SELECT l_orderkey, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_partkey * l_suppkey AS m, round(l_partkey / (l_suppkey + 1), 6) AS d FROM lineitem")
def arith_int(t):
    f = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    f = f.assign("a", f.add("l_partkey", "l_suppkey")).assign("s", f.sub("l_partkey", "l_suppkey")).assign("m", f.mul("l_partkey", "l_suppkey")).assign("p1", f.add_scalar("l_suppkey", 1))
    return f.assign("d", F.round(f.div("l_partkey", "p1"), 6)).select("l_orderkey", "a", "s", "m", "d")


@_query("SELECT l_orderkey, round(l_extendedprice * l_discount, 6) AS m, round(l_extendedprice - l_quantity, 4) AS s, round(l_quantity + 0.5, 4) AS p, round(power(l_quantity, 2), 4) AS q FROM lineitem")
def arith_mixed(t):
    f = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    f = f.assign("m", F.round(f.mul("l_extendedprice", "l_discount"), 6)).assign("s", F.round(f.sub("l_extendedprice", "l_quantity"), 4))
    return f.assign("p", F.round(f.add_scalar("l_quantity", 0.5), 4)).assign("q", F.round(f.pow_scalar("l_quantity", 2), 4)).select("l_orderkey", "m", "s", "p", "q")


@_query("""
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN round(v / (event_id % 3), 6) WHEN v > 0 THEN 'infinity'::DOUBLE WHEN v < 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END AS q
FROM (SELECT event_id, CAST(event_id % 7 - 3 AS DOUBLE) AS v FROM events)""")
def arith_div_zero(t):
    f = t("events").select("event_id").assign("v", F.expr("CAST(event_id % 7 - 3 AS DOUBLE)")).assign("z", F.expr("event_id % 3"))
    return f.assign("q", F.round(f.div("v", "z"), 6)).select("event_id", "q")


@_query("""
SELECT l_orderkey, l_partkey > l_suppkey AS gt, l_partkey <= l_suppkey AS le, l_returnflag = l_linestatus AS eq, l_returnflag <> l_linestatus AS ne, l_quantity < 25 AS lt, false AS cross_eq
FROM lineitem""")
def compare_columns(t):
    f = t("lineitem")
    f = f.assign("gt", f.gt("l_partkey", "l_suppkey")).assign("le", f.le("l_partkey", "l_suppkey")).assign("eq", f.eq("l_returnflag", "l_linestatus")).assign("ne", f.ne("l_returnflag", "l_linestatus"))
    return f.assign("lt", f.lt_scalar("l_quantity", 25)).assign("cross_eq", f.eq("l_returnflag", "l_partkey")).select("l_orderkey", "gt", "le", "eq", "ne", "lt", "cross_eq")


# ------------------------------------------------------------ functions, casts


@_query("SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders")
def apply_column(t):
    return t("orders").select("o_orderkey", "o_orderpriority").apply("o_orderpriority", F.lower)


@_query("SELECT o_orderkey, length(o_orderpriority) * 2 AS o_orderpriority FROM orders")
def apply_udf(t):
    return t("orders").select("o_orderkey", "o_orderpriority").apply("o_orderpriority", lambda v: None if v is None else len(v) * 2, "int")


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def map_values(t):
    return t("orders").select("o_orderkey", "o_orderstatus").map("o_orderstatus", {"F": "done", "O": "open"})


@_query("SELECT n_nationkey AS n_nationkey, length(n_name) AS size, upper(n_name) AS loud FROM nation")
def apply_row(t):
    return t("nation").apply_row(lambda r: {"n_nationkey": r["n_nationkey"], "size": len(r["n_name"]), "loud": r["n_name"].upper()}, {"n_nationkey": "int", "size": "int", "loud": "string"})


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def pipe(t):
    return t("orders").select("o_orderkey", "o_totalprice").pipe(lambda f: f.filter("o_totalprice", ">", 100000.0))


@_query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS key, CAST(o_orderkey AS VARCHAR) AS txt, o_orderkey % 2 <> 0 AS odd FROM orders")
def astype(t):
    f = t("orders").select("o_orderkey", "o_totalprice").rename({"o_totalprice": "whole"}).assign("key", F.col("o_orderkey")).assign("txt", F.col("o_orderkey")).assign("odd", F.expr("o_orderkey % 2"))
    return f.astype("whole", "int").astype("key", "float").astype("txt", "str").astype("odd", "boolean")


@_query("SELECT event_id, CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT) AS n, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS b FROM (SELECT event_id, CAST(event_id AS VARCHAR) || 'abc' AS s FROM events)")
def csv_typed_parse(t):
    from .functions.exprs import parse_prefix
    from .types import BOOL, LONG

    f = t("events").assign("s", F.concat(F.col("event_id").cast("string"), F.lit("abc"))).assign("w", F.expr("CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN '0' WHEN 2 THEN '' ELSE 'yes' END"))
    return f.assign("n", parse_prefix(F.col("s"), LONG)).assign("b", parse_prefix(F.col("w"), BOOL)).select("event_id", "n", "b")


# ---------------------------------------------------------------- missing data

_GAPS = "SELECT event_id, nullif(event_type, 'error') AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 < 2 THEN NULL ELSE user_id END AS u FROM events"


def _gaps(t) -> Frame:
    return t("events").assign("kind", F.expr("nullif(event_type, 'error')")).assign("v", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")).assign("u", F.expr("CASE WHEN event_id % 5 < 2 THEN NULL ELSE user_id END")).select("event_id", "kind", "v", "u")


@_query(f"SELECT event_id, kind, round(coalesce(v, 0), 6) AS v, coalesce(u, 0) AS u FROM ({_GAPS})")
def fillna_const(t):
    return _round(_gaps(t).fillna(0), 6)


@_query(f"SELECT event_id, coalesce(kind, 'none') AS kind, v, u FROM ({_GAPS})")
def fillna_column(t):
    return _gaps(t).fillna_column("kind", "none")


@_query(f"SELECT event_id, last_value(kind IGNORE NULLS) OVER w AS kind, last_value(v IGNORE NULLS) OVER w AS v, last_value(u IGNORE NULLS) OVER w AS u FROM ({_GAPS}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def ffill(t):
    return _gaps(t).fillna_method("ffill")


@_query(f"SELECT event_id, first_value(kind IGNORE NULLS) OVER w AS kind, first_value(v IGNORE NULLS) OVER w AS v, first_value(u IGNORE NULLS) OVER w AS u FROM ({_GAPS}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def bfill(t):
    return _gaps(t).fillna_method("bfill", bucket_rows=3000)


@_query(f"SELECT * FROM ({_GAPS}) WHERE kind IS NOT NULL AND v IS NOT NULL AND u IS NOT NULL")
def dropna_any(t):
    return _gaps(t).dropna()


@_query(f"SELECT * FROM ({_GAPS}) WHERE v IS NOT NULL OR u IS NOT NULL")
def dropna_all(t):
    return _gaps(t).dropna("all", ["v", "u"])


@_query(f"SELECT event_id IS NULL AS event_id, kind IS NULL AS kind, v IS NULL AS v, u IS NULL AS u FROM ({_GAPS})")
def isna(t):
    return _gaps(t).isna()


@_query(f"SELECT kind IS NOT NULL AS kind, v IS NOT NULL AS v FROM ({_GAPS})")
def notna(t):
    return _gaps(t).select("kind", "v").notna()


@_query(f"SELECT count(*) FILTER (WHERE event_id IS NULL) AS event_id, count(*) FILTER (WHERE kind IS NULL) AS kind, count(*) FILTER (WHERE v IS NULL) AS v, count(*) FILTER (WHERE u IS NULL) AS u FROM ({_GAPS})")
def null_count(t):
    f = _gaps(t)
    got = f.null_count()
    return Frame.from_rows(f.sdf.sparkSession, list(got), [[v] for v in got.values()], dict.fromkeys(got, "int"))


# ----------------------------------------------------------------------- joins

for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def _merge(t, how=_how):
        left = t("nation").where("n_nationkey < 20").rename({"n_nationkey": "key"}).select("key", "n_name")
        right = t("supplier").where("s_nationkey > 5").rename({"s_nationkey": "key"}).select("key", "s_name")
        return left.merge(right, "key", how)

    def _merge_on(t, how=_how):
        f = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_tax")
        left = f.where("l_quantity > 45").group_by(["l_partkey", "l_suppkey"]).agg({"l_quantity": "sum"})
        right = f.where("l_tax > 0.07").group_by(["l_partkey", "l_suppkey"]).agg({"l_tax": "count"})
        return left.merge_on(right, ["l_partkey", "l_suppkey"], how)

    _query(f"SELECT key, n_name, s_name FROM (SELECT n_nationkey AS key, n_name FROM nation WHERE n_nationkey < 20) {_kind} (SELECT s_nationkey AS key, s_name FROM supplier WHERE s_nationkey > 5) USING (key)", f"merge_{_how}")(_merge)
    _query(
        f"SELECT l_partkey, l_suppkey, l_quantity_sum, l_tax_count FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS l_quantity_sum FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) {_kind} (SELECT l_partkey, l_suppkey, count(l_tax) AS l_tax_count FROM lineitem WHERE l_tax > 0.07 GROUP BY ALL) USING (l_partkey, l_suppkey)",
        f"merge_on_{_how}",
    )(_merge_on)


@_query("SELECT a.k, a.o_orderkey, b.o_orderkey AS other FROM (SELECT nullif(o_orderstatus, 'P') AS k, o_orderkey FROM orders WHERE o_orderkey < 50) a FULL JOIN (SELECT nullif(o_orderstatus, 'P') AS k, o_orderkey FROM orders WHERE o_orderkey BETWEEN 40 AND 60) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NOT NULL")
def merge_null_keys(t):
    f = t("orders").assign("k", F.expr("nullif(o_orderstatus, 'P')")).select("k", "o_orderkey")
    out = f.where("o_orderkey < 50").merge(f.where("o_orderkey BETWEEN 40 AND 60").rename({"o_orderkey": "other"}), "k", "full").to_spark()
    return out.withColumn("k", F.when(F.col("o_orderkey").isNotNull(), F.col("k")))


# Joined rows in their order, over whole tables: one-to-many, many-to-one and unmatched rows on both sides.

_SIDES = "(SELECT n_nationkey + 5 AS key, n_name, row_number() OVER (ORDER BY n_name DESC) AS a FROM nation) {} (SELECT s_nationkey AS key, s_name, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS b FROM supplier) USING (key)"

for _how, _kind, _by in (("inner", "JOIN", "a, b"), ("left", "LEFT JOIN", "a, b NULLS LAST"), ("right", "RIGHT JOIN", "b, a NULLS LAST"), ("full", "FULL JOIN", "a NULLS LAST, b NULLS LAST")):

    def _merge_order(t, how=_how):
        left = t("nation").assign("key", F.expr("n_nationkey + 5")).select("key", "n_name").sort_values("n_name", ascending=False)
        right = t("supplier").sort_values("s_acctbal").rename({"s_nationkey": "key"}).select("key", "s_name")
        return _rn(left.merge(right, "key", how))

    def _merge_on_order(t, how=_how):
        left = t("orders").sort_values("o_totalprice").rename({"o_custkey": "k1"}).assign("k2", F.expr("k1 % 3")).select("k1", "k2", "o_orderkey")
        right = t("customer").sort_values("c_acctbal").assign("k1", F.expr("c_custkey + 7")).assign("k2", F.expr("(c_custkey + 7) % 3")).select("k1", "k2", "c_name")
        return _rn(left.merge_on(right, ["k1", "k2"], how))

    _query(f"SELECT key, n_name, s_name, row_number() OVER (ORDER BY {_by}) - 1 AS rn FROM {_SIDES.format(_kind)}", f"merge_{_how}_order")(_merge_order)
    _query(
        f"SELECT k1, k2, o_orderkey, c_name, row_number() OVER (ORDER BY {_by}) - 1 AS rn FROM (SELECT o_custkey AS k1, o_custkey % 3 AS k2, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a FROM orders) {_kind} (SELECT c_custkey + 7 AS k1, (c_custkey + 7) % 3 AS k2, c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS b FROM customer) USING (k1, k2)",
        f"merge_on_{_how}_order",
    )(_merge_on_order)


# The same joins over whole tables: keys are shifted or nulled on one side, and no row is left out.

_NULLED_ORDERS = "SELECT CASE WHEN o_orderkey % 50 > 0 THEN o_custkey END AS k, o_orderkey FROM orders"
_NULLED_SUMS = "SELECT CASE WHEN c % 7 > 0 THEN c END AS k, c AS cust, n FROM (SELECT o_custkey AS c, count(o_orderkey) AS n FROM orders GROUP BY 1)"


@_query(f"SELECT a.k, a.o_orderkey, b.cust, b.n FROM ({_NULLED_ORDERS}) a LEFT JOIN ({_NULLED_SUMS}) b ON a.k = b.k UNION ALL SELECT b.k, NULL, b.cust, b.n FROM ({_NULLED_SUMS}) b WHERE b.k IS NULL OR b.k NOT IN (SELECT k FROM ({_NULLED_ORDERS}) WHERE k IS NOT NULL)")
def merge_null_keys_whole(t):
    f = t("orders")
    left = f.assign("k", F.expr("CASE WHEN o_orderkey % 50 > 0 THEN o_custkey END")).select("k", "o_orderkey")
    sums = f.group_by("o_custkey").agg({"o_orderkey": "count"}).rename({"o_custkey": "cust", "o_orderkey_count": "n"})
    return left.merge(sums.assign("k", F.expr("CASE WHEN cust % 7 > 0 THEN cust END")).select("k", "cust", "n"), "k", "full")


for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def _merge_whole(t, how=_how):
        left = t("nation").assign("key", F.expr("n_nationkey + 5")).select("key", "n_name")
        return left.merge(t("supplier").rename({"s_nationkey": "key"}).select("key", "s_name"), "key", how)

    def _merge_on_whole(t, how=_how):
        f = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_tax")
        left = f.group_by(["l_partkey", "l_suppkey"]).agg({"l_quantity": "sum"})
        right = f.assign("l_partkey", F.expr("l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1000000000 ELSE 0 END")).group_by(["l_partkey", "l_suppkey"]).agg({"l_tax": "count"})
        return left.merge_on(right, ["l_partkey", "l_suppkey"], how)

    _query(f"SELECT key, n_name, s_name FROM (SELECT n_nationkey + 5 AS key, n_name FROM nation) {_kind} (SELECT s_nationkey AS key, s_name FROM supplier) USING (key)", f"merge_{_how}_whole")(_merge_whole)
    _query(
        f"SELECT l_partkey, l_suppkey, l_quantity_sum, l_tax_count FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS l_quantity_sum FROM lineitem GROUP BY ALL) {_kind} (SELECT l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1000000000 ELSE 0 END AS l_partkey, l_suppkey, count(l_tax) AS l_tax_count FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey)",
        f"merge_on_{_how}_whole",
    )(_merge_on_whole)


# ----------------------------------------------------------------- aggregation

for _fn, _sql in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):

    def _group(t, fn=_fn):
        return _round(getattr(t("orders").select("o_orderstatus", "o_custkey", "o_totalprice").group_by("o_orderstatus"), fn)(), 2)

    _query(f"SELECT o_orderstatus, CAST(round({_sql}(o_custkey), 2) AS DOUBLE) AS o_custkey, round({_sql}(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1", f"groupby_{_fn}")(_group)


@_query("""
SELECT user_id, round(sum(value), 4) AS value_sum, round(avg(value), 4) AS value_mean, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max, round(stddev_samp(value), 4) AS value_std,
  round(median(value), 4) AS value_median, arg_min(value, event_id) AS value_first, arg_max(value, event_id) AS value_last, arg_min(event_type, event_id) AS event_type_first FROM events GROUP BY user_id""")
def groupby_agg_all9(t):
    out = t("events").group_by("user_id").agg({"value": ["sum", "mean", "count", "min", "max", "std", "median", "first", "last"], "event_type": ["first"]})
    for c in ("sum", "mean", "std", "median"):
        out = out.assign(f"value_{c}", F.round(f"value_{c}", 4))
    return out


@_query(f"SELECT kind, count(v) AS v_count, round(coalesce(sum(v), 0), 4) AS v_sum FROM ({_GAPS}) GROUP BY kind")
def groupby_null_key(t):
    out = _gaps(t).group_by("kind").agg({"v": ["count", "sum"]})
    return out.assign("v_sum", F.round("v_sum", 4))


@_query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, round(avg(l_discount), 6) AS l_discount_mean, count(l_orderkey) AS l_orderkey_count FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def groupby_pricing_summary(t):
    out = t("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").group_by(["l_returnflag", "l_linestatus"]).agg({"l_extendedprice": "sum", "l_discount": "mean", "l_orderkey": "count"})
    return out.assign("l_extendedprice_sum", F.round("l_extendedprice_sum", 2)).assign("l_discount_mean", F.round("l_discount_mean", 6)).select("l_returnflag", "l_linestatus", "l_extendedprice_sum", "l_discount_mean", "l_orderkey_count")


@_query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2")
def groupby_head(t):
    return t("events").select("event_type", "event_id", "value").group_by("event_type").head(2)


@_query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(max(value) - min(value), 4) AS spread FROM events GROUP BY event_type")
def groupby_apply(t):
    def spread(rows):
        return rows.groupby("event_type", as_index=False).agg(n=("value", "size"), hi=("value", "max"), lo=("value", "min")).assign(spread=lambda d: (d.hi - d.lo).round(4))

    return t("events").select("event_type", "value").group_by("event_type").apply(spread, "event_type string, n long, spread double")


@_query("SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, r) - 1 AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def groupby_apply_order(t):
    last = lambda rows: rows.iloc[::-1].head(3)[["o_orderstatus", "o_orderkey"]]
    return _rn(t("orders").select("o_orderkey", "o_orderstatus").group_by("o_orderstatus").apply(last, "o_orderstatus string, o_orderkey long"))


# ------------------------------------------------------------------ statistics

_STATS = ["l_quantity", "l_extendedprice"]


@_query(" UNION ALL ".join(f"SELECT '{s}' AS statistic, round({e.format('l_quantity')}, 3)::DOUBLE AS l_quantity, round({e.format('l_extendedprice')}, 3)::DOUBLE AS l_extendedprice FROM lineitem" for s, e in (
    ("count", "count({})"), ("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("25%", "quantile_cont({}, 0.25)"), ("50%", "quantile_cont({}, 0.5)"), ("75%", "quantile_cont({}, 0.75)"), ("max", "max({})"))))
def describe(t):
    return _round(t("lineitem").select(*_STATS).describe(), 3)


for _fn, _sql in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max")):

    def _reduce(t, fn=_fn):
        f = t("lineitem").select(*_STATS)
        got = getattr(f, fn)()
        return _round(Frame.from_rows(f.sdf.sparkSession, list(got), [[float(v)] for v in got.values()], dict.fromkeys(got, "float")), 3)

    _query(f"SELECT round({_sql}(l_quantity), 3) AS l_quantity, round({_sql}(l_extendedprice), 3) AS l_extendedprice FROM lineitem", f"frame_{_fn}")(_reduce)


@_query("SELECT event_type, count(*) AS \"count\", row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS rn FROM events GROUP BY event_type")
def value_counts(t):
    return _rn(t("events").value_counts("event_type"))


@_query("SELECT count(DISTINCT user_id) AS n FROM events")
def nunique(t):
    f = t("events")
    return Frame.from_rows(f.sdf.sparkSession, ["n"], [[f.nunique("user_id")]], {"n": "int"})


for _fn, _cell in (("corr", "round(corr({0}, {1}), 6)"), ("cov", "round(covar_samp({0}, {1}), 3)")):

    def _matrix(t, fn=_fn):
        f = _round(getattr(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount"), fn)(), 6 if fn == "corr" else 3)
        return f.sdf.select(F.col("__index").alias("label"), *f.columns)

    _query(" UNION ALL ".join(f"SELECT '{a}' AS label, " + ", ".join(f"{_cell.format(a, b)} AS {b}" for b in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount")), f"{_fn}_matrix")(_matrix)


@_query(f"SELECT kind, row_number() OVER (ORDER BY first) - 1 AS rn FROM (SELECT kind, min(event_id) AS first FROM ({_GAPS}) GROUP BY kind)")
def unique_first_seen(t):
    return _rn(_gaps(t).unique("kind"))


@_query(None)
def sample_n(t):
    return t("customer").sample(50, 42)


@_query("SELECT 50::BIGINT AS n, 50::BIGINT AS ids, 50::BIGINT AS members, true AS again")
def sample_invariants(t):
    f = t("customer")
    drawn, again = f.sample(50, 42), f.sample(50, 42)
    ids = [r[0] for r in drawn.select("c_custkey").collect()]
    return Frame.from_columns(f.sdf.sparkSession, {"n": [len(ids)], "ids": [len(set(ids))], "members": [f.where(F.col("c_custkey").isin(ids)).sdf.count()], "again": [ids == [r[0] for r in again.select("c_custkey").collect()]]})


# ------------------------------------------------------------------ duplicates

for _keep, _flag in (("first", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1"), ("last", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) > 1"), ("none", "count(*) OVER (PARTITION BY user_id, event_type) > 1")):

    def _duplicated(t, keep=_keep):
        return _rn(t("events").duplicated(["user_id", "event_type"], keep))

    def _drop_duplicates(t, keep=_keep):
        return t("events").select("event_id", "user_id", "event_type").drop_duplicates(["user_id", "event_type"], keep)

    _query(f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn, {_flag} AS duplicated FROM events", f"duplicated_{_keep}")(_duplicated)
    _query(f"SELECT event_id, user_id, event_type FROM events QUALIFY NOT ({_flag})", f"drop_duplicates_{_keep}")(_drop_duplicates)


# -------------------------------------------------------------- ordered windows

for _fn, _sql in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")):

    def _rolling(t, fn=_fn):
        f = _gaps(t).select("v").rolling(4, bucket_rows=1_000_000 if fn != "mean" else 2500)
        return _round(Frame(_rn(getattr(f, fn)())), 4)

    _query(f"SELECT rn, CASE WHEN count(v) OVER w = 4 THEN round({_sql}(v) OVER w, 4) END AS v FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn, v FROM ({_GAPS})) WINDOW w AS (ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", f"rolling_{_fn}")(_rolling)

for _name, _by, _sql in (("shift_down", 2, "lag({0}, 2)"), ("shift_up", -3, "lead({0}, 3)")):

    def _shift(t, by=_by):
        return _rn(_gaps(t).select("kind", "v").shift(by, bucket_rows=4000))

    _query(f"SELECT row_number() OVER w - 1 AS rn, {_sql.format('kind')} OVER w AS kind, {_sql.format('v')} OVER w AS v FROM ({_GAPS}) WINDOW w AS (ORDER BY event_id)", _name)(_shift)

for _fn, _sql in (("cumsum", "sum"), ("cummax", "max"), ("cummin", "min")):

    def _cumulative(t, fn=_fn):
        return _round(Frame(_rn(getattr(_gaps(t).select("v", "kind"), fn)(bucket_rows=1_000_000 if fn != "cummax" else 2500))), 3)

    _query(f"SELECT row_number() OVER w - 1 AS rn, CASE WHEN v IS NOT NULL THEN round({_sql}(v) OVER w, 3) END AS v, kind FROM ({_GAPS}) WINDOW w AS (ORDER BY event_id)", _fn)(_cumulative)


@_query("SELECT row_number() OVER w - 1 AS rn, round(product(1 + value / 1e7) OVER w, 6) AS x FROM events WINDOW w AS (ORDER BY event_id)")
def cumprod(t):
    return _round(Frame(_rn(t("events").assign("x", F.expr("1 + value / 1e7")).select("x").cumprod())), 6)


# The ordered operators in many small buckets, where the queries above have a single one.

for _fn, _sql in (("cumsum", "sum"), ("cummin", "min")):

    def _cumulative_buckets(t, fn=_fn):
        return _round(Frame(_rn(getattr(_gaps(t).select("v", "kind"), fn)(bucket_rows=1500))), 3)

    _query(ORACLE[_fn], f"{_fn}_buckets")(_cumulative_buckets)

for _fn in ("sum", "min", "max", "std"):

    def _rolling_buckets(t, fn=_fn):
        return _round(Frame(_rn(getattr(_gaps(t).select("v").rolling(4, bucket_rows=700), fn)())), 4)

    _query(ORACLE[f"rolling_{_fn}"], f"rolling_{_fn}_buckets")(_rolling_buckets)


@_query(ORACLE["cumprod"])
def cumprod_buckets(t):
    return _round(Frame(_rn(t("events").assign("x", F.expr("1 + value / 1e7")).select("x").cumprod(bucket_rows=1500))), 6)


@_query(ORACLE["ffill"])
def ffill_buckets(t):
    return _gaps(t).fillna_method("ffill", bucket_rows=1500)


# --------------------------------------------------------------------- sorting


@_query(f"SELECT row_number() OVER (ORDER BY kind DESC NULLS LAST, v ASC NULLS LAST, event_id) - 1 AS rn, event_id FROM ({_GAPS})")
def sort_multi_nulls_last(t):
    return _rn(_gaps(t).sort_values(["kind", "v"], [False, True]).select("event_id"))


@_query(f"SELECT row_number() OVER (ORDER BY u ASC NULLS FIRST, event_id) - 1 AS rn, event_id FROM ({_GAPS})")
def sort_nulls_first(t):
    return _rn(_gaps(t).sort_values("u", na_position="first").select("event_id"))


@_query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS rn, c_custkey FROM customer")
def sort_index(t):
    return _rn(t("customer").set_index("c_name").sort_index().select("c_custkey"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").topk("o_totalprice", 10)


# -------------------------------------------------------------- concatenation


@_query("SELECT c_name AS name, c_acctbal AS bal, c_mktsegment, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, 'S' FROM supplier")
def concat_rows_outer(t):
    a = t("customer").rename({"c_name": "name", "c_acctbal": "bal"}).select("name", "bal", "c_mktsegment")
    b = t("supplier").rename({"s_name": "name", "s_acctbal": "bal"}).select("name", "bal")
    return concat([a, b.assign("extra", F.lit("S")), None])


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def concat_rows_inner(t):
    a = t("customer").rename({"c_custkey": "id", "c_acctbal": "bal"}).select("id", "bal", "c_mktsegment")
    b = t("supplier").rename({"s_name": "id", "s_acctbal": "bal"}).select("id", "bal")
    return concat([a, b], join="inner")


for _how, _kind in (("outer", "FULL JOIN"), ("inner", "JOIN")):

    def _concat_columns(t, how=_how):
        a = t("nation").set_index("n_name").select("n_nationkey", "n_regionkey").where("n_nationkey < 15")
        b = t("nation").assign("twice", F.expr("n_nationkey * 2")).where("n_nationkey > 8").set_index("n_name").select("twice")
        f = concat([a, b], axis=1, join=how)
        return f.sdf.select(F.col("__index").alias("label"), *f.columns)

    _query(f"SELECT label, n_nationkey, n_regionkey, twice FROM (SELECT n_name AS label, n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 15) {_kind} (SELECT n_name AS label, n_nationkey * 2 AS twice FROM nation WHERE n_nationkey > 8) USING (label)", f"concat_columns_{_how}")(_concat_columns)

    def _concat_columns_whole(t, how=_how):
        a = t("nation").set_index("n_name").select("n_nationkey", "n_regionkey")
        b = t("nation").assign("twice", F.expr("n_nationkey * 2")).assign("n_name", F.expr("CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE concat(n_name, ' 2') END")).set_index("n_name").select("twice")
        f = concat([a, b], axis=1, join=how)
        return f.sdf.select(F.col("__index").alias("label"), *f.columns)

    _query(f"SELECT label, n_nationkey, n_regionkey, twice FROM (SELECT n_name AS label, n_nationkey, n_regionkey FROM nation) {_kind} (SELECT CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE n_name || ' 2' END AS label, n_nationkey * 2 AS twice FROM nation) USING (label)", f"concat_columns_{_how}_whole")(_concat_columns_whole)


# --------------------------------------------------------------------- reshape

for _fn, _sql in (("sum", "sum"), ("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):

    def _pivot(t, fn=_fn):
        return _round(t("orders").pivot_table("o_orderpriority", "o_orderstatus", "o_totalprice", fn), 2)

    _query("SELECT o_orderpriority, " + ", ".join(f"nullif(round({_sql}(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2)::DOUBLE, {0 if _fn == 'count' else -1e18}) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1", f"pivot_{_fn}")(_pivot)


@_query("SELECT CAST(n AS VARCHAR) AS c_nationkey, " + ", ".join(f"coalesce(round(sum(b) FILTER (WHERE s = '{s}'), 2), 0) AS {s}" for s in ("BUILDING", "MACHINERY")) + " FROM (SELECT c_nationkey AS n, c_acctbal AS b, c_mktsegment AS s FROM customer WHERE c_custkey % 9 = 0) GROUP BY n")
def pivot_fill(t):
    return _round(t("customer").where("c_custkey % 9 = 0").pivot_table("c_nationkey", "c_mktsegment", "c_acctbal", "sum", 0.0, ["MACHINERY", "BUILDING"]), 2)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@_query("SELECT CAST(n AS VARCHAR) AS c_nationkey, " + ", ".join(f"coalesce(round(sum(b) FILTER (WHERE s = '{s}'), 2), 0) AS \"{s}\"" for s in (*_SEGMENTS, "NONE")) + " FROM (SELECT c_nationkey AS n, c_acctbal AS b, CASE WHEN c_nationkey % 5 = 0 AND c_mktsegment <> 'BUILDING' THEN 'NONE' ELSE c_mktsegment END AS s FROM customer) GROUP BY n")
def pivot_fill_whole(t):
    """Every customer and segment; nations divisible by 5 lack most levels, the others NONE."""
    f = t("customer").assign("level", F.expr("CASE WHEN c_nationkey % 5 = 0 AND c_mktsegment <> 'BUILDING' THEN 'NONE' ELSE c_mktsegment END"))
    return _round(f.pivot_table("c_nationkey", "level", "c_acctbal", "sum", 0.0, ["NONE", *_SEGMENTS]), 2)


@_query("SELECT l_returnflag, " + ", ".join(f"round(avg({v}) FILTER (WHERE l_linestatus = '{s}'), 4) AS {v}_{s}" for v in ("l_quantity", "l_tax") for s in "FO") + " FROM lineitem GROUP BY 1")
def pivot_multi_values(t):
    return _round(t("lineitem").pivot_table(["l_returnflag"], "l_linestatus", ["l_quantity", "l_tax"]), 4)


@_query(f"SELECT event_id, 'v' AS variable, v AS value FROM ({_GAPS}) UNION ALL SELECT event_id, 'u', CAST(u AS DOUBLE) FROM ({_GAPS})")
def melt(t):
    return _gaps(t).melt(["event_id"], ["v", "u"])


@_query("SELECT c_name AS \"index\", variable, value FROM (SELECT c_name, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_name, 'key', CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) END FROM customer) WHERE value IS NOT NULL")
def stack(t):
    return t("customer").set_index("c_name").assign("key", F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_custkey END")).select("c_acctbal", "key").stack()


@_query("SELECT c_name AS label, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) END AS key FROM customer")
def unstack(t):
    f = t("customer").set_index("c_name").assign("key", F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_custkey END")).select("c_acctbal", "key").stack().unstack()
    return f.sdf.select(F.col("__index").alias("label"), *f.columns)


# --------------------------------------------------------------------- scalars


@_query("""
SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, trim('  ' || p_name || ' ') AS st, replace(p_name, 'a', '<a>') AS re, contains(p_name, 'a') AS co, starts_with(p_name, 'P') AS sw, suffix(p_name, '1') AS ew,
  CAST(length(p_name) AS BIGINT) AS n, string_split(p_type, ' ') AS sp FROM part""")
def str_functions(t):
    f = t("part")
    s = f.str("p_name")
    f = f.assign("padded", F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
    for name, c in {"lo": s.lower(), "up": s.upper(), "st": f.str("padded").strip(), "re": s.replace("a", "<a>"), "co": s.contains("a"), "sw": s.startswith("P"), "ew": s.endswith("1"), "n": s.len(), "sp": f.str("p_type").split(" ")}.items():
        f = f.assign(name, c)
    return f.select("p_partkey", "lo", "up", "st", "re", "co", "sw", "ew", "n", "sp")


@_query(r"SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def str_title(t):
    f = t("part").assign("title", F.lower("p_type"))
    return f.assign("title", f.str("title").title()).select("p_partkey", "title")


@_query("""
SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, CAST(dayofweek(ts) AS BIGINT) AS w, strftime(ts, '%Y-%m-%d') AS dt FROM events""")
def dt_parts(t):
    f = t("events").select("event_id", "ts")
    d = f.dt("ts")
    for name, c in {"y": d.year(), "mo": d.month(), "d": d.day(), "h": d.hour(), "mi": d.minute(), "s": d.second(), "w": d.weekday(), "dt": d.date()}.items():
        f = f.assign(name, c)
    return f.drop(columns=["ts"])


@_query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS iso, date_trunc('day', o_orderdate)::TIMESTAMP AS us FROM orders")
def to_datetime(t):
    f = t("orders").assign("iso", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).assign("us", F.date_format("o_orderdate", "MM/dd/yyyy")).select("o_orderkey", "iso", "us")
    return f.to_datetime("iso").to_datetime("us", "01/02/2006")


@_query("SELECT o_orderkey, o_orderpriority, CAST(c.code AS INTEGER) AS o_orderpriority_code FROM orders JOIN (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) c ON o_orderpriority = p")
def categorical_codes(t):
    return t("orders").select("o_orderkey", "o_orderpriority").as_categorical("o_orderpriority")


@_query("SELECT o_orderpriority AS category, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS code FROM orders GROUP BY 1")
def categories(t):
    return t("orders").categories("o_orderpriority").sdf


@_query("""
SELECT CAST(least(floor((l_extendedprice - lo) / w), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS "count", round(min(lo + least(floor((l_extendedprice - lo) / w), 9) * w), 4) AS lo
FROM lineitem, (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem) GROUP BY 1""")
def histogram_bins(t):
    return plot.histogram_bins(t("lineitem"), "l_extendedprice", 10).select("bin", "count", F.round("lo", 4).alias("lo"))


# ------------------------------------------------------------------ round trips


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment || ', \"x\"' AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS gap FROM customer")
def csv_roundtrip(t):
    f = t("customer").select("c_custkey", "c_name", "c_mktsegment").assign("c_mktsegment", F.concat("c_mktsegment", F.lit(', "x"'))).assign("gap", F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END"))
    f.to_csv(path := _shared(f, "csv"))
    return readers.read_csv(f.sdf.sparkSession, path)


@_query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal, 6) END AS bal, c_custkey % 2 = 0 AS even FROM customer")
def csv_typed_roundtrip(t):
    f = t("customer").select("c_custkey", "c_acctbal").assign("bal", F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END")).assign("even", F.expr("c_custkey % 2 = 0")).select("c_custkey", "bal", "even")
    f.to_csv(path := _shared(f, "csv"))
    return _round(readers.read_csv_typed(f.sdf.sparkSession, path, {"c_custkey": "int", "bal": "float", "even": "bool"}), 6)


@_query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') || chr(10) || ', \"x\"' AS source FROM documents")
def csv_roundtrip_lines(t):
    f = t("documents").select("doc_id", "text", "source").assign("source", F.concat(F.expr("coalesce(source, '')"), F.lit('\n, "x"')))
    f.to_csv(path := _shared(f, "csv"))
    return readers.read_csv(f.sdf.sparkSession, path)


@_query("SELECT c_custkey, c_name || chr(10) || 'a, b' AS c_name, round(c_acctbal, 6) AS bal FROM customer")
def csv_typed_roundtrip_lines(t):
    f = t("customer").select("c_custkey", "c_name", "c_acctbal").rename({"c_acctbal": "bal"}).assign("c_name", F.concat("c_name", F.lit("\na, b")))
    f.to_csv(path := _shared(f, "csv"))
    return _round(readers.read_csv_typed(f.sdf.sparkSession, path, {"c_custkey": "int", "bal": "float"}), 6)


@_query("SELECT round(c_acctbal, 6) AS c_acctbal, CAST(c_custkey AS DOUBLE) AS c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS c_name FROM customer")
def json_roundtrip(t):
    f = t("customer").assign("c_name", F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END")).select("c_custkey", "c_acctbal", "c_name")
    f.to_json(path := _shared(f, "json"))
    return _round(readers.read_json(f.sdf.sparkSession, path, lines=True), 6)


@_query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS c_name FROM customer")
def parquet_roundtrip(t):
    f = t("customer").assign("c_name", F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END")).select("c_custkey", "c_nationkey", "c_acctbal", "c_name")
    f.to_parquet(path := _shared(f, "parquet"))
    return readers.read_parquet(f.sdf.sparkSession, path)


@_query("SELECT c_acctbal, c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS c_name FROM customer")
def parquet_zero_nulls(t):
    f = t("customer").assign("c_name", F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END")).select("c_custkey", "c_acctbal", "c_name")
    f.to_parquet(path := _shared(f, "parquet"), "zero")
    return readers.read_parquet(f.sdf.sparkSession, path)


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE '' END AS n_name FROM nation")
def excel_roundtrip(t):
    f = t("nation").assign("n_name", F.expr("CASE WHEN n_nationkey % 4 > 0 THEN n_name END")).select("n_nationkey", "n_name")
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "nation.xlsx")  # written and read by the driver alone
    f.to_excel(path)
    return readers.read_excel(f.sdf.sparkSession, path)


@_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_views(t):
    f = t("orders")
    f.to_spark().createOrReplaceTempView("tidemark_orders")
    return readers.read_sql(f.sdf.sparkSession, "SELECT o_orderstatus, count(*) AS n FROM tidemark_orders GROUP BY 1")


# ------------------------------------------------------------ cells and display


@_query(f"SELECT 'event_id' AS name, 'int64' AS dtype, count(event_id) AS known FROM ({_GAPS}) UNION ALL SELECT 'kind', 'string', count(kind) FROM ({_GAPS}) UNION ALL SELECT 'v', 'float64', count(v) FROM ({_GAPS}) UNION ALL SELECT 'u', 'int64', count(u) FROM ({_GAPS})")
def info(t):
    f = _gaps(t)
    n, lost, kinds = len(f), f.null_count(), f.dtypes()
    return Frame.from_columns(f.sdf.sparkSession, {"name": f.columns, "dtype": [kinds[c] for c in f.columns], "known": [n - lost[c] for c in f.columns]})


@_query("SELECT (SELECT n_name FROM nation WHERE n_nationkey = 7) AS by_label, (SELECT n_regionkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) WHERE r = 5)::BIGINT AS by_position, false AS missing")
def cell_access(t):
    f = t("nation")
    values = {"by_label": [f.set_index("n_nationkey").loc.at("7", "n_name")], "by_position": [f.iloc.at(4, 2)], "missing": [f.iloc.is_null_at(0, 1)]}
    return Frame.from_columns(f.sdf.sparkSession, values)


@_query("SELECT rn, CASE rn WHEN 2 THEN 'two' WHEN 3 THEN NULL ELSE n_name END AS n_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rn, n_name FROM nation) UNION ALL SELECT count(*), 'last' FROM nation")
def series_writes(t):
    return _rn(t("nation").series("n_name").set(2, "two").set_null(3).append("last").frame)


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 6 AS rn, n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) BETWEEN 6 AND 9")
def series_slice(t):
    return _rn(t("nation").series("n_name").slice(5, 9).frame)


@_query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'a', 0.5::DOUBLE, true), (1, 2, NULL, NULL, false), (2, NULL, 'c', 2.0, NULL)) v(rn, id, name, x, ok)")
def constructors(t):
    spark = t("region").sdf.sparkSession
    rows = Frame.from_rows(spark, ["id", "name", "x", "ok"], [[1, 2, None], ["a", None, "c"], [0.5, None, 2.0], [True, False, None]], {"id": "int", "name": str, "x": "float64", "ok": "bool"})
    none = Frame.empty(spark, ["id", "name", "x", "ok"], {"id": "int", "x": "float", "ok": "bool"})
    return _rn(concat([none, rows]))


@_query(f"SELECT 0 AS rn, count(*) || ' rows x 4 columns' AS line FROM ({_GAPS}) UNION ALL SELECT 1, 'event_id  ' || count(event_id) || ' non-null  int64' FROM ({_GAPS}) UNION ALL SELECT 2, 'kind  ' || count(kind) || ' non-null  string' FROM ({_GAPS}) UNION ALL SELECT 3, 'v  ' || count(v) || ' non-null  float64' FROM ({_GAPS}) UNION ALL SELECT 4, 'u  ' || count(u) || ' non-null  int64' FROM ({_GAPS})")
def info_text(t):
    f = _gaps(t)
    lines = f.info().split("\n")
    return Frame.from_columns(f.sdf.sparkSession, {"rn": list(range(len(lines))), "line": lines}).sdf.select(F.col("rn").cast("int").alias("rn"), "line")


@_query("""
SELECT * FROM (VALUES (0, '+-------------+-------------+'), (1, '| r_regionkey | r_name      |'), (2, '+-------------+-------------+')) v(rn, line)
UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY r_regionkey) AS INTEGER), '| ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' FROM region
UNION ALL SELECT CAST(3 + count(*) AS INTEGER), '+-------------+-------------+' FROM region UNION ALL SELECT CAST(4 + count(*) AS INTEGER), '[' || count(*) || ' rows x 2 columns]' FROM region""")
def text_table(t):
    f = t("region").select("r_regionkey", "r_name").assign("r_name", F.rpad("r_name", 11, " "))
    lines = str(f).split("\n")
    return Frame.from_columns(f.sdf.sparkSession, {"rn": list(range(len(lines))), "line": lines}).sdf.select(F.col("rn").cast("int").alias("rn"), "line")


@_query("SELECT o_orderkey AS by_name, o_totalprice AS by_label_access, o_orderkey AS by_position FROM orders")
def column_reads(t):
    f = t("orders").select("o_orderkey", "o_totalprice")
    return f.sdf.select(f.select_col("o_orderkey").alias("by_name"), f.loc.col("o_totalprice").alias("by_label_access"), f.iloc.col(0).alias("by_position"))


@_query("SELECT c_name, c_custkey, c_acctbal FROM customer")
def column_sets(t):
    f = t("customer").select("c_custkey", "c_acctbal", "c_name")
    return f.iloc.cols([2, 0]).to_spark().join(f.loc.cols(["c_custkey", "c_acctbal"]).to_spark(), "c_custkey").select("c_name", "c_custkey", "c_acctbal")


@_query("SELECT 'label' AS how, n_nationkey, n_name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) UNION ALL SELECT 'position', n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) WHERE r = 4")
def row_reads(t):
    f = t("nation").select("n_nationkey", "n_name")
    least = f.sort_values("n_name").head(1).select("n_name").collect()[0][0]
    by_label = f.set_index("n_name").loc.row(least).to_spark().select(F.lit("label").alias("how"), "n_nationkey", "n_name")
    return by_label.unionByName(f.iloc.row(3).to_spark().select(F.lit("position").alias("how"), "n_nationkey", "n_name"))


@_query("SELECT (SELECT n_nationkey % 4 = 0 FROM nation WHERE n_nationkey = 8) AS at_8, (SELECT n_nationkey % 4 = 0 FROM nation WHERE n_nationkey = 9) AS at_9")
def null_reads(t):
    f = t("nation").assign("part", F.expr("CASE WHEN n_nationkey % 4 > 0 THEN n_name END")).set_index("n_nationkey")
    return Frame.from_columns(f.sdf.sparkSession, {"at_8": [f.loc.is_null_at("8", "part")], "at_9": [f.loc.is_null_at("9", "part")]})


@_query("SELECT o_orderkey, true AS fine FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def filter_ends(t):
    chain = t("orders").filter("o_totalprice", ">", 200000.0).filter("o_orderstatus", "==", "O")
    return chain.must_result().assign("fine", F.lit(chain.err() is None)).select("o_orderkey", "fine")


@_query("SELECT l_orderkey, round(power(l_quantity, l_tax), 6) AS p, round(l_extendedprice - 0.5, 4) AS s, round(l_extendedprice / 7, 6) AS d, CASE WHEN l_tax > 0 THEN 'infinity'::DOUBLE ELSE 'nan'::DOUBLE END AS z FROM lineitem")
def arith_scalars(t):
    f = t("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_tax")
    f = f.assign("p", F.round(f.pow("l_quantity", "l_tax"), 6)).assign("s", F.round(f.sub_scalar("l_extendedprice", 0.5), 4))
    return f.assign("d", F.round(f.div_scalar("l_extendedprice", 7), 6)).assign("z", f.div_scalar("l_tax", 0)).select("l_orderkey", "p", "s", "d", "z")


@_query("SELECT l_orderkey, l_partkey < l_suppkey AS lt, l_partkey >= l_suppkey AS ge, l_quantity > 25 AS gts, l_quantity >= 25 AS ges, l_quantity <= 25 AS les, l_quantity = 25 AS eqs, l_returnflag <> 'R' AS nes, true AS cross_ne FROM lineitem")
def compare_scalars(t):
    f = t("lineitem")
    parts = {"lt": f.lt("l_partkey", "l_suppkey"), "ge": f.ge("l_partkey", "l_suppkey"), "gts": f.gt_scalar("l_quantity", 25), "ges": f.ge_scalar("l_quantity", 25), "les": f.le_scalar("l_quantity", 25), "eqs": f.eq_scalar("l_quantity", 25), "nes": f.ne_scalar("l_returnflag", "R"), "cross_ne": f.ne_scalar("l_returnflag", 1)}
    for name, c in parts.items():
        f = f.assign(name, c)
    return f.select("l_orderkey", *parts)


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rn, part, part IS NULL AS missing, (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 0) AS nulls, (SELECT n_name FROM nation WHERE n_nationkey = 5) AS at_5 FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS part FROM nation)")
def series_reads(t):
    f = t("nation").assign("part", F.expr("CASE WHEN n_nationkey % 4 > 0 THEN n_name END"))
    s = f.series("part")
    values, mask, n, at = s.values(), s.mask(), s.null_count(), s.at(5)
    assert s.is_null(4) and not s.is_null(5) and len(s) == len(values)
    return Frame.from_columns(f.sdf.sparkSession, {"rn": list(range(len(values))), "part": values, "missing": mask, "nulls": [n] * len(values), "at_5": [at] * len(values)})


@_query("""
WITH a AS (SELECT DISTINCT n_regionkey AS v FROM nation WHERE n_nationkey < 12), b AS (SELECT DISTINCT n_regionkey AS v FROM nation WHERE n_nationkey >= 20)
SELECT 'union' AS op, v FROM (SELECT v FROM a UNION SELECT v FROM b) UNION ALL SELECT 'intersect', v FROM (SELECT v FROM a INTERSECT SELECT v FROM b)
UNION ALL SELECT 'difference', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL SELECT 'filter', v FROM a WHERE v % 2 = 0 UNION ALL SELECT 'added', v FROM (SELECT v FROM a UNION SELECT 77 UNION SELECT 78 UNION SELECT 79)""")
def set_operations(t):
    from .collection import Set

    f = t("nation")
    a, b = (Set(r[0] for r in f.where(w).select("n_regionkey").collect()) for w in ("n_nationkey < 12", "n_nationkey >= 20"))
    more = Set(a.to_list())
    more.add(77)
    more.add_multi(78, 79)
    out = {"union": a.union(b), "intersect": a.intersect(b), "difference": a.difference(b), "filter": a.filter(lambda v: v % 2 == 0), "added": more}
    rows = [(op, v) for op, s in out.items() for v in s.to_list()]
    return Frame.from_columns(f.sdf.sparkSession, {"op": [r[0] for r in rows], "v": [r[1] for r in rows]}).to_spark()


@_query("SELECT 'bar' AS chart, (SELECT count(*) FROM nation) AS marks UNION ALL SELECT 'pie', (SELECT count(*) FROM nation WHERE n_nationkey > 0) UNION ALL SELECT 'scatter', (SELECT count(*) FROM nation) UNION ALL SELECT 'line', 3 UNION ALL SELECT 'heatmap', (SELECT 2 * count(*) FROM nation)")
def chart_marks(t):
    """How many marks each chart of the nations has: a line chart has its axes and two lines."""
    f = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "chart.html")  # drawn and read by the driver alone
    mark = {"bar": "<rect", "pie": "<path", "scatter": "<circle", "line": "<path", "heatmap": "<rect"}
    draw = {
        "bar": lambda: f.plot_bar("n_name", "n_nationkey", output_path=path), "pie": lambda: f.plot_pie("n_name", "n_nationkey", output_path=path), "scatter": lambda: f.plot_scatter("n_nationkey", "n_regionkey", output_path=path),
        "line": lambda: f.plot_line("n_name", ["n_nationkey", "n_regionkey"], output_path=path), "heatmap": lambda: f.plot_heatmap(output_path=path),
    }
    marks = []
    for name, fn in draw.items():
        fn()
        with open(path, encoding="utf-8") as page:
            marks.append(page.read().count(mark[name]))
    return Frame.from_columns(f.sdf.sparkSession, {"chart": list(draw), "marks": marks}).to_spark()
