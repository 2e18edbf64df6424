"""Driver queries over the public test tables, each with its SQL twin.

Every query is a script of the column language; its result vectors become a
DataFrame whose columns have the names of the twin's.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import int32
from .plans.frame import NumVal, evaluate
from .plans.session import Session
from .sources import storage
from .sources.catalog import Catalog

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "supplier": ["s_suppkey", "s_nationkey"],
}


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    s = Session(spark, Catalog(tempfile.mkdtemp(prefix="catalog-"), storage.scratch(spark)))
    s.run('create(db,"d")')
    for t in tables:
        s.attach(t, f"{sf_dir}/{t}.parquet", COLUMNS[t])
    return s


def do(s: Session, script: str) -> Session:
    said = [x for x in s.script(line.strip() for line in script.strip().splitlines()) if x]
    if said:
        raise RuntimeError(f"unexpected output: {said}")
    return s


def values(s: Session, /, **names: str) -> DataFrame:
    """Value vectors (column = handle) as a DataFrame."""
    df = s.rows(*names.values())
    return df.select(*(F.col(f"v{i}").alias(c) for i, c in enumerate(names)))


def positions(s: Session, /, **names: str) -> DataFrame:
    df = s.position_rows(*names.values())
    return df.select(*(F.col(f"p{i}").alias(c) for i, c in enumerate(names)))


def numbers(s: Session, /, **names: str) -> DataFrame:
    """Numeric values over one frame as a one-row DataFrame, in one aggregate."""
    found: dict[str, NumVal] = {c: s.numbers[h] for c, h in names.items()}
    frame = next(iter(found.values())).frame
    if any(v.frame is not frame for v in found.values()):
        raise ValueError("these numbers are of different frames")
    df = frame.over(frozenset().union(*(v.uses for v in found.values())))
    return df.agg(*(int32.aggregate(v.kind, v.column).alias(c) for c, v in found.items()))


def _select(table: str, script: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: positions(do(session(spark, sf, table), script), pos="p")


def _values(table: str, script: str, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: values(do(session(spark, sf, table, *more), script), v="v")


def _number(script: str, **names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: numbers(do(session(spark, sf, "lineitem"), script), **names)


def add_wrap(spark: SparkSession, sf: str) -> DataFrame:
    """Addition beyond 32 bits, against a vector of large constants made by an update."""
    s = session(spark, sf, "orders")
    do(s, """
        p=select(d.orders.o_orderkey,null,null)
        keep=fetch(d.orders.o_custkey,p)
        relational_update(d.orders.o_custkey,p,2147483000)
        big=fetch(d.orders.o_custkey,p)
        v=add(keep,big)
    """)
    return values(s, v="v")


BOSS = """
    p1=select(d.lineitem.l_partkey,200,900)
    f1=fetch(d.lineitem.l_suppkey,p1)
    p2=select(p1,f1,20,80)
    a=fetch(d.lineitem.l_partkey,p2)
    b=fetch(d.lineitem.l_suppkey,p2)
    c=fetch(d.lineitem.l_linenumber,p2)
    x=add(a,b)
    y=sub(c,b)
    a1=avg(x)
    mn=min(b)
    mx=max(c)
    s=sum(y)
"""


def _join(algorithm: str) -> Callable[[SparkSession, str], DataFrame]:
    script = f"""
        p1=select(d.orders.o_orderkey,null,null)
        p2=select(d.customer.c_custkey,null,null)
        k1=fetch(d.orders.o_custkey,p1)
        k2=fetch(d.customer.c_custkey,p2)
        t1,t2=join(k1,p1,k2,p2,{algorithm})
        x=fetch(d.orders.o_orderkey,t1)
        y=fetch(d.customer.c_nationkey,t2)
        s=sum(x)
        a=avg(y)
    """
    return lambda spark, sf: numbers(do(session(spark, sf, "orders", "customer"), script), s="s", a="a")


def join_positions(spark: SparkSession, sf: str) -> DataFrame:
    s = do(session(spark, sf, "orders", "customer"), """
        p1=select(d.orders.o_orderkey,null,null)
        p2=select(d.customer.c_custkey,null,null)
        k1=fetch(d.orders.o_custkey,p1)
        k2=fetch(d.customer.c_custkey,p2)
        t1,t2=join(k1,p1,k2,p2,hash)
    """)
    return positions(s, pos1="t1", pos2="t2")


def join_many_many(spark: SparkSession, sf: str) -> DataFrame:
    s = do(session(spark, sf, "supplier", "customer"), """
        p1=select(d.supplier.s_suppkey,null,null)
        p2=select(d.customer.c_custkey,null,null)
        k1=fetch(d.supplier.s_nationkey,p1)
        k2=fetch(d.customer.c_nationkey,p2)
        t1,t2=join(k1,p1,k2,p2,hash)
        x=fetch(d.supplier.s_suppkey,t1)
    """)
    return values(s, x="x").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("s"))


def _batch(single: bool) -> Callable[[SparkSession, str], DataFrame]:
    lines = [f"p{q}=select(d.orders.o_custkey,{100 * q},{100 * q + 30})" for q in range(10)]
    script = "\n".join([*(["single_core()"] if single else []), "batch_queries()", *lines, "batch_execute()", *(["single_core_execute()"] if single else [])])

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = do(session(spark, sf, "orders"), script)
        shared, tag, _ = s.positions["p0"].frame.tag  # the one pass that all ten share
        df = shared.df.coalesce(1) if single else shared.df
        return df.select(F.col(tag).alias("q"), F.col(s.positions["p0"].source.pos).alias("pos"))

    return run


def batch_agg(spark: SparkSession, sf: str) -> DataFrame:
    s = do(session(spark, sf, "orders"), """
        batch_queries()
        mn=min(d.orders.o_custkey)
        mx=max(d.orders.o_custkey)
        s=sum(d.orders.o_custkey)
        a=avg(d.orders.o_custkey)
        batch_execute()
    """)
    return numbers(s, mn="mn", mx="mx", s="s", a="a")


def _index(structure: str, layout: str, column: str, low: int, high: int, other: str) -> Callable[[SparkSession, str], DataFrame]:
    script = f"""
        create(idx,d.lineitem.{column},{structure},{layout})
        p=select(d.lineitem.{column},{low},{high})
        v=fetch(d.lineitem.{other},p)
    """
    return lambda spark, sf: values(do(session(spark, sf, "lineitem"), script), v="v")


def _loaded(spark: SparkSession, sf: str) -> Session:
    s = session(spark, sf)
    path = storage.scratch(spark) + "/orders.csv"
    src = spark.read.parquet(f"{sf}/orders.parquet")
    src.select(*(F.col(c).alias(f"d.orders.{c}") for c in COLUMNS["orders"])).coalesce(1).write.option("header", True).csv(path)
    return do(s, f"""
        create(tbl,"orders",d,2)
        create(col,"o_orderkey",d.orders)
        create(col,"o_custkey",d.orders)
        load("{path}")
    """)


def load_csv(spark: SparkSession, sf: str) -> DataFrame:
    s = do(_loaded(spark, sf), "p=select(d.orders.o_orderkey,null,null)\na=fetch(d.orders.o_orderkey,p)\nb=fetch(d.orders.o_custkey,p)")
    return values(s, o_orderkey="a", o_custkey="b")


def restart(spark: SparkSession, sf: str) -> DataFrame:
    s = _loaded(spark, sf)
    s.run("shutdown")
    s = Session(spark, Catalog(str(s.catalog.root), s.catalog.data))
    return values(s, o_orderkey="d.orders.o_orderkey", o_custkey="d.orders.o_custkey")


def _changed(script: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: values(do(session(spark, sf, "supplier"), script), k="d.supplier.s_suppkey", n="d.supplier.s_nationkey")


def print_values(spark: SparkSession, sf: str) -> DataFrame:
    s = do(session(spark, sf, "orders"), "p=select(d.orders.o_custkey,3,6)\na=fetch(d.orders.o_orderkey,p)\nb=fetch(d.orders.o_custkey,p)")
    return s.rows("a", "b").select(F.concat_ws(",", F.col("v0").cast("string"), F.col("v1").cast("string")).alias("line"))


def print_numbers(spark: SparkSession, sf: str) -> DataFrame:
    s = session(spark, sf, "lineitem")
    lines = list(s.script(["a=avg(d.lineitem.l_linenumber)", "m=min(d.lineitem.l_partkey)", "print(a,m)", "print(m)"]))
    return spark.createDataFrame([(x,) for x in lines], "line string")


def batch_fetch_cross(spark: SparkSession, sf: str) -> DataFrame:
    """A handle of a batch used after it: positions of one table fetch from another, beside aggregates that share the scan."""
    s = do(session(spark, sf, "customer", "supplier"), """
        batch_queries()
        p0=select(d.supplier.s_nationkey,0,12)
        p1=select(d.supplier.s_nationkey,12,null)
        batch_execute()
        f0=fetch(d.customer.c_nationkey,p0)
        x=sum(f0)
        g1=fetch(d.supplier.s_suppkey,p1)
        y=max(g1)
        g0=fetch(d.supplier.s_suppkey,p0)
        z=sum(g0)
    """)
    evaluate([s.numbers[n] for n in "xyz"])
    return spark.createDataFrame([tuple(s.numbers[n].value for n in "xyz")], "x long, y int, z long")


def _agg(kind: str) -> str:
    return f"p=select(d.lineitem.l_suppkey,null,null)\nf=fetch(d.lineitem.l_partkey,p)\nx={kind}(f)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "select_range": _select("orders", "p=select(d.orders.o_custkey,100,200)"),
    "select_open_low": _select("orders", "p=select(d.orders.o_custkey,null,50)"),
    "select_open_high": _select("orders", "p=select(d.orders.o_custkey,1450,null)"),
    "select_point": _select("orders", "p=select(d.orders.o_custkey,7,8)"),
    "select_refine": _select("orders", "q=select(d.orders.o_custkey,100,600)\nf=fetch(d.orders.o_orderkey,q)\np=select(q,f,2000,9000)"),
    "select_fetch": _values("orders", "p=select(d.orders.o_orderkey,100,300)\nv=fetch(d.orders.o_custkey,p)"),
    "fetch_cross_table": _values("orders", "p=select(d.orders.o_orderkey,null,500)\nv=fetch(d.customer.c_nationkey,p)", "customer"),
    "add_cols": _values("orders", "p=select(d.orders.o_custkey,100,200)\na=fetch(d.orders.o_custkey,p)\nb=fetch(d.orders.o_orderkey,p)\nv=add(a,b)"),
    "sub_cols": _values("orders", "p=select(d.orders.o_custkey,100,200)\na=fetch(d.orders.o_custkey,p)\nb=fetch(d.orders.o_orderkey,p)\nv=sub(a,b)"),
    "add_wrap": add_wrap,
    "agg_min": _number(_agg("min"), m="x"),
    "agg_max": _number(_agg("max"), m="x"),
    "agg_sum": _number(_agg("sum"), s="x"),
    "agg_avg": _number(_agg("avg"), a="x"),
    "agg_empty": _number("p=select(d.lineitem.l_partkey,null,-5)\nf=fetch(d.lineitem.l_partkey,p)\nmn=min(f)\nmx=max(f)\ns=sum(f)\na=avg(f)", mn="mn", mx="mx", s="s", a="a"),
    "boss": _number(BOSS, a1="a1", mn="mn", mx="mx", s="s"),
    "join_nested_loop": _join("nested-loop"),
    "join_naive_hash": _join("naive-hash"),
    "join_grace_hash": _join("grace-hash"),
    "join_hash": _join("hash"),
    "join_positions": join_positions,
    "join_many_many": join_many_many,
    "batch_select": _batch(False),
    "batch_agg": batch_agg,
    "single_core_batch": _batch(True),
    "idx_clustered_sorted": _index("sorted", "clustered", "l_partkey", 500, 520, "l_suppkey"),
    "idx_clustered_btree": _index("btree", "clustered", "l_partkey", 500, 520, "l_suppkey"),
    "idx_unclustered_sorted": _index("sorted", "unclustered", "l_suppkey", 5, 7, "l_partkey"),
    "idx_unclustered_btree": _index("btree", "unclustered", "l_suppkey", 5, 7, "l_partkey"),
    "load_csv": load_csv,
    "insert_rows": _changed("relational_insert(d.supplier,-1,-11)\nrelational_insert(d.supplier,-2,-22)"),
    "update_rows": _changed("p=select(d.supplier.s_suppkey,10,20)\nrelational_update(d.supplier.s_nationkey,p,-7)"),
    "delete_rows": _changed("p=select(d.supplier.s_nationkey,5,10)\nrelational_delete(d.supplier,p)"),
    "dml_sequence": _changed("relational_insert(d.supplier,-1,-11)\np=select(d.supplier.s_suppkey,null,5)\nrelational_update(d.supplier.s_nationkey,p,99)\nq=select(d.supplier.s_suppkey,50,60)\nrelational_delete(d.supplier,q)"),
    "print_values": print_values,
    "restart": restart,
    "print_numbers": print_numbers,
    "batch_fetch_cross": batch_fetch_cross,
}

_JOINED = "SELECT CAST(sum(o_orderkey) AS BIGINT) AS s, CAST(sum(c_nationkey) AS DOUBLE) / count(*) AS a FROM orders JOIN customer ON o_custkey = c_custkey"
_BATCH = "SELECT q, o_orderkey AS pos FROM orders JOIN (SELECT CAST(range AS INTEGER) AS q FROM range(10)) r ON o_custkey >= 100 * q AND o_custkey < 100 * q + 30"
_PART = "FROM lineitem"
_CLUSTERED = "SELECT CAST(l_suppkey AS INTEGER) AS v FROM lineitem WHERE l_partkey >= 500 AND l_partkey < 520"
_UNCLUSTERED = "SELECT CAST(l_partkey AS INTEGER) AS v FROM lineitem WHERE l_suppkey >= 5 AND l_suppkey < 7"
_ORDERS = "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders"

ORACLES: dict[str, str] = {
    "print_numbers": """
        SELECT unnest([printf('%.2f', CAST(sum(l_linenumber) AS DOUBLE) / count(*)) || ',' || CAST(min(l_partkey) AS VARCHAR), CAST(min(l_partkey) AS VARCHAR)]) AS line FROM lineitem""",
    "batch_fetch_cross": """
        WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
        c AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
        SELECT (SELECT CAST(sum(c_nationkey) AS BIGINT) FROM s JOIN c USING (pos) WHERE s_nationkey < 12) AS x,
            (SELECT CAST(max(s_suppkey) AS INTEGER) FROM s WHERE s_nationkey >= 12) AS y,
            (SELECT CAST(sum(s_suppkey) AS BIGINT) FROM s WHERE s_nationkey < 12) AS z""",
    "select_range": "SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= 100 AND o_custkey < 200",
    "select_open_low": "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 50",
    "select_open_high": "SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= 1450",
    "select_point": "SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= 7 AND o_custkey < 8",
    "select_refine": "SELECT o_orderkey AS pos FROM orders WHERE o_custkey >= 100 AND o_custkey < 600 AND o_orderkey >= 2000 AND o_orderkey < 9000",
    "select_fetch": "SELECT CAST(o_custkey AS INTEGER) AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300",
    "fetch_cross_table": "SELECT CAST(c.c_nationkey AS INTEGER) AS v FROM orders o JOIN customer c ON c.c_custkey = o.o_orderkey WHERE o.o_orderkey < 500",
    "add_cols": "SELECT CAST(o_custkey + o_orderkey AS INTEGER) AS v FROM orders WHERE o_custkey >= 100 AND o_custkey < 200",
    "sub_cols": "SELECT CAST(o_custkey - o_orderkey AS INTEGER) AS v FROM orders WHERE o_custkey >= 100 AND o_custkey < 200",
    "add_wrap": "SELECT CAST(((CAST(o_custkey AS BIGINT) + 2147483000 + 2147483648) & 4294967295) - 2147483648 AS INTEGER) AS v FROM orders",
    "agg_min": f"SELECT CAST(min(l_partkey) AS INTEGER) AS m {_PART}",
    "agg_max": f"SELECT CAST(max(l_partkey) AS INTEGER) AS m {_PART}",
    "agg_sum": f"SELECT CAST(sum(l_partkey) AS BIGINT) AS s {_PART}",
    "agg_avg": f"SELECT CAST(sum(l_partkey) AS DOUBLE) / count(*) AS a {_PART}",
    "agg_empty": "SELECT CAST(coalesce(min(l_partkey), 2147483647) AS INTEGER) AS mn, CAST(coalesce(max(l_partkey), -2147483648) AS INTEGER) AS mx, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS s, coalesce(CAST(sum(l_partkey) AS DOUBLE) / nullif(count(*), 0), 0.0) AS a FROM lineitem WHERE l_partkey < -5",
    "boss": "SELECT CAST(sum(l_partkey + l_suppkey) AS DOUBLE) / count(*) AS a1, CAST(min(l_suppkey) AS INTEGER) AS mn, CAST(max(l_linenumber) AS INTEGER) AS mx, CAST(sum(l_linenumber - l_suppkey) AS BIGINT) AS s FROM lineitem WHERE l_partkey >= 200 AND l_partkey < 900 AND l_suppkey >= 20 AND l_suppkey < 80",
    "join_nested_loop": _JOINED,
    "join_naive_hash": _JOINED,
    "join_grace_hash": _JOINED,
    "join_hash": _JOINED,
    "join_positions": "SELECT o_orderkey AS pos1, c_custkey AS pos2 FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_many_many": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(a.s_suppkey) AS BIGINT) AS s FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey",
    "batch_select": _BATCH,
    "batch_agg": "SELECT CAST(min(o_custkey) AS INTEGER) AS mn, CAST(max(o_custkey) AS INTEGER) AS mx, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS a FROM orders",
    "single_core_batch": _BATCH,
    "idx_clustered_sorted": _CLUSTERED,
    "idx_clustered_btree": _CLUSTERED,
    "idx_unclustered_sorted": _UNCLUSTERED,
    "idx_unclustered_btree": _UNCLUSTERED,
    "load_csv": _ORDERS,
    "insert_rows": "SELECT CAST(s_suppkey AS INTEGER) AS k, s_nationkey AS n FROM supplier UNION ALL SELECT -1, -11 UNION ALL SELECT -2, -22",
    "update_rows": "SELECT CAST(s_suppkey AS INTEGER) AS k, CAST(CASE WHEN s_suppkey >= 10 AND s_suppkey < 20 THEN -7 ELSE s_nationkey END AS INTEGER) AS n FROM supplier",
    "delete_rows": "SELECT CAST(s_suppkey AS INTEGER) AS k, s_nationkey AS n FROM supplier WHERE NOT (s_nationkey >= 5 AND s_nationkey < 10)",
    "dml_sequence": "SELECT k, n FROM (SELECT CAST(s_suppkey AS INTEGER) AS k, CAST(CASE WHEN s_suppkey < 5 THEN 99 ELSE s_nationkey END AS INTEGER) AS n FROM supplier UNION ALL SELECT -1, 99) t WHERE NOT (k >= 50 AND k < 60)",
    "print_values": "SELECT CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) AS line FROM orders WHERE o_custkey >= 3 AND o_custkey < 6",
    "restart": _ORDERS,
}
