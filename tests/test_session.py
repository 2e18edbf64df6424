"""Scripts of the column language against numpy models."""

import random
import re

import numpy as np
import pytest

from stratum.plans.session import Session


def table(s, name, columns, path, indexes=()):
    """Create, index and load a table from numpy columns."""
    n = len(columns)
    lines = [f'create(tbl,"{name}",db1,{n})', *(f'create(col,"col{i + 1}",db1.{name})' for i in range(n)), *(f"create(idx,db1.{name}.{i})" for i in indexes), f'load("{path}")']
    with open(path, "w") as f:
        f.write(",".join(f"db1.{name}.col{i + 1}" for i in range(n)) + "\n")
        for row in zip(*columns, strict=True):
            f.write(",".join(map(str, row)) + "\n")
    assert run(s, lines) == []


def run(s, lines):
    return [x for x in s.script(lines) if x]


@pytest.fixture
def s(spark, tmp_path):
    s = Session(spark, str(tmp_path / "db"))
    s.run('create(db,"db1")')
    return s


@pytest.fixture
def data():
    r = np.random.default_rng(42)
    n = 3000
    c1 = r.integers(-n // 2, n // 2, n)
    return [c1, r.integers(-n // 2, n // 2, n) + c1, r.integers(0, 100, n), r.integers(2**31 - 10000, 2**31, n)]


def text(values):
    return [str(int(x)) for x in values]


def test_ddl_load_restart_and_open_bounds(spark, tmp_path, s):
    r = np.random.default_rng(47)
    c2 = r.permutation(np.arange(10, 1010))
    table(s, "tbl1", [np.arange(1000), c2], tmp_path / "a.csv")
    assert run(s, ["shutdown"]) == []
    s = Session(spark, str(tmp_path / "db"))
    assert s.describe() == ["db1.tbl1(col1, col2): 1000 rows, version 1"]
    assert run(s, ["s1=select(db1.tbl1.col1,null,20)", "f1=fetch(db1.tbl1.col2,s1)", "print(f1)"]) == text(c2[:20])
    assert run(s, ["s2=select(db1.tbl1.col1,987,null)", "f2=fetch(db1.tbl1.col2,s2)", "print(f2)"]) == text(c2[987:])
    assert run(s, ["s1=select(db1.tbl1.col1,20,10)", "f1=fetch(db1.tbl1.col2,s1)", "print(f1)"]) == []


def test_aggregates_and_arithmetic(tmp_path, s, data):
    table(s, "tbl2", data, tmp_path / "a.csv")
    c1, c2, c3, c4 = data
    m = (c1 >= -500) & (c1 < 700) & (c3 >= 10) & (c3 < 40)
    got = run(s, [
        "-- a comment", "  ", "s1=select(db1.tbl2.col1,-500,700)", "f1=fetch(db1.tbl2.col3,s1)", "s2=select(s1,f1,10,40)",
        "a=fetch(db1.tbl2.col1,s2)", "b=fetch(db1.tbl2.col2,s2)", "x=add(a,b)", "y=sub(b,a)",
        "mn=min(x)", "mx=max(y)", "sm=sum(x)", "av=avg(y)", "print(mn,mx,sm,av)", "print(x)", "print(a,y)",
        "whole=avg(db1.tbl2.col1)", "print(whole)", "t=add(db1.tbl2.col4,db1.tbl2.col4)", "ts=sum(t)", "print(ts)",
    ])
    x, y = (c1 + c2)[m], (c2 - c1)[m]
    wrapped = ((2 * c4 + 2**31) % 2**32) - 2**31
    want = [f"{x.min()},{y.max()},{x.sum()},{y.mean():.2f}", *text(x), *(f"{p},{q}" for p, q in zip(c1[m], y, strict=True)), f"{c1.mean():.2f}", str(wrapped.sum())]
    assert got == want


def test_empty_aggregates_and_two_decimals(tmp_path, s):
    table(s, "t", [np.array([0, 0, 0, 0, 0, 0, 0, 1])], tmp_path / "a.csv")
    assert run(s, ["p=select(db1.t.col1,5,9)", "f=fetch(db1.t.col1,p)", "a=min(f)", "b=max(f)", "c=sum(f)", "d=avg(f)", "print(a,b,c,d)", "e=avg(db1.t.col1)", "print(e)", "print(f)"]) == ["2147483647,-2147483648,0,0.00", "0.12"]


@pytest.mark.parametrize("count", [2, 10, 60])
def test_batches(tmp_path, s, data, count):
    table(s, "t", data, tmp_path / "a.csv")
    c1, c2, *_ = data
    r = random.Random(count)
    bounds = [(lo := r.randrange(-1500, 1400), lo + r.randrange(0, 400)) for _ in range(count)]
    bounds[0] = ("null", bounds[0][1])
    lines = ["batch_queries()", *(f"s{i}=select(db1.t.col1,{a},{b})" for i, (a, b) in enumerate(bounds)), "m=max(db1.t.col1)", "batch_execute()"]
    lines += [x for i in range(count) for x in (f"f{i}=fetch(db1.t.col2,s{i})", f"a{i}=sum(f{i})", f"print(a{i})")] + ["print(m)"]
    want = [str(c2[(c1 >= (-10**9 if a == "null" else a)) & (c1 < b)].sum()) for a, b in bounds] + [str(c1.max())]
    assert run(s, lines) == want
    assert run(s, ["single_core()", *lines, "single_core_execute()"]) == want


def test_batch_within_positions_and_errors(tmp_path, s, data):
    table(s, "t", data, tmp_path / "a.csv")
    c1, c2, c3, _ = data
    m = (c1 >= 0) & (c1 < 900)
    got = run(s, ["p=select(db1.t.col1,0,900)", "f=fetch(db1.t.col3,p)", "batch_queries()", "a=select(p,f,0,20)", "b=select(p,f,10,50)", "n=min(f)", "print(n)", "c=select(db1.t.col1,0,1)", "batch_queries()", "batch_execute()", "x=fetch(db1.t.col2,a)", "y=fetch(db1.t.col2,b)", "sx=sum(x)", "sy=sum(y)", "print(sx)", "print(sy)", "print(n)", "batch_execute()"])
    assert got == ["Unbatchable command type.", "Incompatible batch query.", "Cannot start a new batch before the current one is executed.", str(c2[m & (c3 < 20)].sum()), str(c2[m & (c3 >= 10) & (c3 < 50)].sum()), str(c3[m].min()), "No batch to execute."]


INDEXES = [(), ("col3,sorted,clustered", "col2,btree,unclustered"), ("col3,btree,clustered", "col2,sorted,unclustered"), ("col2,btree,unclustered",)]


@pytest.mark.parametrize("indexes", INDEXES)
@pytest.mark.parametrize("first", [True, False])
def test_indexes_do_not_change_answers(tmp_path, s, data, indexes, first):
    table(s, "t", data, tmp_path / "a.csv", indexes if first else ())
    if not first:
        assert run(s, [f"create(idx,db1.t.{i})" for i in indexes]) == []
    order = np.argsort(data[2], kind="stable") if any(",clustered" in i for i in indexes) else np.arange(len(data[0]))
    c1, c2, c3, _ = (c[order] for c in data)
    m, k = (c3 >= 20) & (c3 < 24), (c2 >= 100) & (c2 < 160)
    got = run(s, ["p=select(db1.t.col3,20,24)", "f=fetch(db1.t.col1,p)", "print(f)", "q=select(db1.t.col2,100,160)", "g=fetch(db1.t.col1,q)", "h=fetch(db1.t.col2,q)", "print(g)", "print(h)", "a=sum(h)", "print(a)"])
    assert got == text(c1[m]) + text(c1[k]) + text(c2[k]) + [str(c2[k].sum())]


def test_covering_index_answers_alone(tmp_path, s, data):
    table(s, "t", data, tmp_path / "a.csv", ("col2,sorted,unclustered",))
    assert run(s, ["q=select(db1.t.col2,100,160)", "h=fetch(db1.t.col2,q)"]) == []
    assert "t.col2-" in s.rows("h").inputFiles()[0]


@pytest.mark.parametrize("algorithm", ["nested-loop", "naive-hash", "grace-hash", "hash"])
def test_joins(tmp_path, s, algorithm):
    r = np.random.default_rng(1)
    a = [r.integers(0, 40, 300), r.integers(0, 1000, 300)]
    b = [r.integers(0, 40, 200), r.integers(0, 1000, 200)]
    table(s, "a", a, tmp_path / "a.csv")
    table(s, "b", b, tmp_path / "b.csv")
    got = run(s, ["p=select(db1.a.col2,null,800)", "q=select(db1.b.col2,100,null)", "f=fetch(db1.a.col1,p)", "g=fetch(db1.b.col1,q)", f"t1,t2=join(f,p,g,q,{algorithm})", "x=fetch(db1.a.col2,t1)", "y=fetch(db1.b.col2,t2)", "print(x,y)", "c=sum(x)", "d=avg(y)", "print(c,d)", "z=fetch(db1.a.col2,t2)", "e=sum(z)", "print(e)"])
    pairs = [(i, j) for i in range(300) for j in range(200) if a[1][i] < 800 and b[1][j] >= 100 and a[0][i] == b[0][j]]
    want = [f"{a[1][i]},{b[1][j]}" for i, j in pairs]
    assert sorted(got[:-2]) == sorted(want)
    assert got[-2:] == [f"{sum(a[1][i] for i, _ in pairs)},{np.mean([b[1][j] for _, j in pairs]):.2f}", str(sum(a[1][j] for _, j in pairs))]  # t2 gathers from the other table too


def test_join_plans(tmp_path, s):
    table(s, "a", [np.arange(50)], tmp_path / "a.csv")
    nodes = {"nested-loop": "CartesianProduct", "naive-hash": "BroadcastHashJoin", "grace-hash": "ShuffledHashJoin"}
    for algorithm, node in nodes.items():
        run(s, ["p=select(db1.a.col1,null,null)", "f=fetch(db1.a.col1,p)", f"t,u=join(f,p,f,p,{algorithm})"])
        assert node in s.positions["t"].frame.df._jdf.queryExecution().executedPlan().toString()
    assert run(s, ["t,u=join(f,p,f,p,other)", "t=join(f,p,f,p,hash)"]) == ["Unknown join algorithm: other.", "Two output handles required."]


def test_one_scan(tmp_path, s, data):
    table(s, "t", data, tmp_path / "a.csv")
    run(s, ["p=select(db1.t.col1,0,500)", "f=fetch(db1.t.col2,p)", "q=select(p,f,0,300)", "g=fetch(db1.t.col3,q)", "h=fetch(db1.t.col2,q)", "z=add(g,h)"])
    plan = s.rows("z")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "PushedFilters: [" in plan and "col4" not in plan
    run(s, ["batch_queries()", *(f"s{i}=select(db1.t.col1,{i},{i + 9})" for i in range(20)), "batch_execute()"])
    plan = s.positions["s3"].frame.tag[0].df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_vector_positions_and_zips(tmp_path, s, data):
    table(s, "t", data, tmp_path / "a.csv")
    c1, c2, c3, _ = data
    m = (c1 >= 0) & (c1 < 900)
    v = c3[m]
    k = np.flatnonzero((v >= 10) & (v < 30))  # places within the vector
    got = run(s, ["p=select(db1.t.col1,0,900)", "v=fetch(db1.t.col3,p)", "q=select(v,10,30)", "w=fetch(v,q)", "print(w)", "u=fetch(db1.t.col2,q)", "print(u)", "b=fetch(db1.t.col2,p)", "x=fetch(b,q)", "print(x)"])
    assert got == text(v[k]) + text(c2[k]) + text(c2[m][k])
    lo, hi = np.flatnonzero(c3 < 50), np.flatnonzero(c3 >= 50)
    n = min(len(lo), len(hi))
    got = run(s, ["p=select(db1.t.col3,null,50)", "q=select(db1.t.col3,50,null)", "a=fetch(db1.t.col1,p)", "b=fetch(db1.t.col1,q)", "z=add(a,b)", "print(z)"])
    if len(lo) == len(hi):
        assert got == text(c1[lo] + c1[hi])
    else:
        assert got[0] == "Vectors must have the same length." and n > 0


@pytest.mark.parametrize("indexes", INDEXES)
def test_changes_against_a_model(spark, tmp_path, s, indexes):
    r = random.Random(len(indexes))
    cols = [np.array([r.randrange(-20, 20) for _ in range(40)]) for _ in range(3)]
    table(s, "t", cols, tmp_path / "a.csv", indexes)
    key = next((int(i[3]) - 1 for i in indexes if i.endswith(",clustered")), None)
    model = [tuple(int(x) for x in row) for row in zip(*cols, strict=True)]
    settle = lambda rows: rows if key is None else sorted(rows, key=lambda row: row[key])
    model = settle(model)
    for step in range(8):
        kind = r.choice(["insert", "insert", "update", "delete"])
        if kind == "insert":
            row = tuple(r.randrange(-20, 20) for _ in range(3))
            assert run(s, [f"relational_insert(db1.t,{','.join(map(str, row))})"]) == []
            model = settle([*model, row])
            continue
        c, lo = r.randrange(3), r.randrange(-20, 15)
        hi = lo + r.randrange(1, 8)
        assert run(s, [f"p=select(db1.t.col{c + 1},{lo},{hi})"]) == []
        if kind == "delete":
            assert run(s, ["relational_delete(db1.t,p)"]) == []
            model = [row for row in model if not lo <= row[c] < hi]
        else:
            k, x = r.randrange(3), r.randrange(-20, 20)
            assert run(s, [f"relational_update(db1.t.col{k + 1},p,{x})"]) == []
            model = settle([row[:k] + (x,) + row[k + 1 :] if lo <= row[c] < hi else row for row in model])
        if step == 4:
            run(s, ["shutdown"])
            s = Session(spark, str(tmp_path / "db"))
    got = run(s, ["print(db1.t.col1,db1.t.col2,db1.t.col3)"])
    assert got == [",".join(map(str, row)) for row in model]


def test_snapshots_and_stale_positions(tmp_path, s):
    table(s, "t", [np.arange(10), np.arange(10) * 10], tmp_path / "a.csv")
    got = run(s, ["p=select(db1.t.col1,2,5)", "old=fetch(db1.t.col2,p)", "q=select(db1.t.col1,3,4)", "relational_update(db1.t.col2,q,-1)", "new=fetch(db1.t.col2,p)", "print(old)", "print(new)"])
    assert got == ["20", "30", "40", "20", "-1", "40"]
    got = run(s, ["q=select(db1.t.col1,0,1)", "relational_delete(db1.t,q)", "moved=fetch(db1.t.col1,p)", "print(moved)"])
    assert got == ["3", "4", "5"]
    run(s, ["q=select(db1.t.col1,9,10)"])
    run(s, ["r=select(db1.t.col1,1,9)", "relational_delete(db1.t,r)", "gone=fetch(db1.t.col1,q)"])
    assert run(s, ["print(gone)", "x=sum(gone)", "n=sum(moved)", "print(n)", "print(x)"]) == ["Position out of range.", "12", "Position out of range."]


def test_updates_by_filters_do_not_shuffle(spark, tmp_path, s):
    table(s, "t", [np.arange(2000), np.arange(2000) % 7], tmp_path / "a.csv")
    assert run(s, ["relational_insert(db1.t,-5,3)", "p=select(db1.t.col2,3,5)", "q=select(p,p,0,1)"]) == ["Value vector p does not exist."]
    old = s.catalog.tables["t"].version.segments
    assert run(s, ["relational_update(db1.t.col1,p,9)"]) == []
    new = s.catalog.tables["t"].version.segments
    assert len(new) == 2 and [x.offsets for x in new] == [x.offsets for x in old] and {x.path for x in new}.isdisjoint(x.path for x in old)
    want = [9 if i % 7 in (3, 4) else i for i in range(2000)] + [9]
    assert run(s, ["print(db1.t.col1)"]) == text(want)


def test_errors(tmp_path, s, data):
    table(s, "t", data[:2], tmp_path / "a.csv")
    cases = {
        "nonsense": "Invalid command.",
        "x=select(db1.t.col1,a,3)": "Not a number: a.",
        "x=select(db1.t.col1,1)": "Wrong number of arguments for select.",
        "x=select(db1.t.col9,1,2)": "Column col9 does not exist in table t.",
        "x=fetch(db1.t.col1,nope)": "Position vector nope does not exist.",
        "x=min(nope)": "Value vector nope does not exist.",
        'create(tbl,"t",db1,2)': "Table t already exists.",
        'create(tbl,"u",db2,2)': "Database db2 does not exist.",
        'create(tbl,"u",db1,0)': "The number of columns must be positive.",
        'create(col,"col3",db1.t)': "Table t is full.",
        'create(col,"col1",db1.t)': "Column col1 already exists.",
        "create(idx,db1.t.col1,hash,clustered)": "Unknown kind of index.",
        "relational_insert(db1.t,1)": "One value for each column required.",
        "relational_insert(db1.t,1,x)": "Not a number: x.",
        "relational_insert(db1.t,1,99999999999)": "Value out of range.",
        "single_core_execute()": "Not in single-core mode.",
        "print()": "Nothing to print.",
        "print(" + ",".join(["a"] * 65) + ")": "At most 64 handles can be printed.",
    }
    for line, said in cases.items():
        assert run(s, [line]) == [said], line
    assert run(s, ['create(tbl,"u",db1,2)', 'create(col,"a",db1.u)', "x=min(db1.u.a)"]) == ["Table u is not fully initialized."]
    (tmp_path / "bad.csv").write_text("db1.t.col2,db1.t.col1\n1,2\n")
    assert run(s, [f'load("{tmp_path / "bad.csv"}")']) == ["The header must name all columns of the table in order."]
    assert run(s, ["select(db1.t.col1,0,5)", "min(db1.t.col1)", "single_core()", "single_core()"]) == ["Already in single-core mode."]
    (tmp_path / "worse.csv").write_text("db1.t.col1,db1.t.col2\n1,x\n")
    said = run(s, [f'load("{tmp_path / "worse.csv"}")', f'load("{tmp_path / "nope.csv"}")', "x=max(db1.t.col1)", "print(x)"])
    assert re.search("(?i)malformed|parse|cannot|failed", said[0]) and "nope.csv" in said[1] and said[2:] == [str(data[0].max())]
    assert all("\n" not in x for x in said)
    assert s.describe()[0].startswith("db1.t(col1, col2): 3000 rows")


def test_namespaces(tmp_path, s, data):
    table(s, "t", data[:2], tmp_path / "a.csv")
    c1, c2 = data[:2]
    m = (c1 >= 0) & (c1 < 50)
    assert run(s, ["x=select(db1.t.col1,0,50)", "x=fetch(db1.t.col2,x)", "x=sum(x)", "print(x)", "y=fetch(x,x)"])[0] == str(c2[m].sum())


def test_batch_handles_after_the_batch(tmp_path, s):
    """Fetches from another table, zips and more batches over the handles of one."""
    table(s, "t", [np.arange(50), np.arange(50) % 7], tmp_path / "a.csv")
    table(s, "u", [np.arange(60) * 3, np.arange(60)], tmp_path / "b.csv")
    got = run(s, [
        "batch_queries()", "p0=select(db1.t.col2,0,3)", "p1=select(db1.t.col2,3,null)", "batch_execute()",
        "f0=fetch(db1.u.col1,p0)", "x0=sum(f0)", "print(x0)", "g0=fetch(db1.t.col1,p0)", "y0=sum(g0)", "print(y0)",
        "f1=fetch(db1.t.col1,p1)", "x1=sum(f1)", "z=add(f0,g0)", "w=max(z)", "print(x1,w)", "print(x0)",
        "batch_queries()", "q0=select(p0,f0,0,30)", "q1=select(p0,f0,30,60)", "batch_execute()", "h=fetch(db1.t.col1,q1)", "print(h)",
    ])
    at = [k for k in range(50) if k % 7 < 3]
    rest = [k for k in range(50) if k % 7 >= 3]
    assert got == [str(3 * sum(at)), str(sum(at)), f"{sum(rest)},{4 * max(at)}", str(3 * sum(at)), *(str(k) for k in at if 30 <= 3 * k < 60)]


def test_zips_leave_a_table_s_frame_alone(tmp_path, s):
    table(s, "t", [np.arange(40), np.arange(40) * 2], tmp_path / "a.csv")
    table(s, "u", [np.arange(40), np.arange(40) * 3], tmp_path / "b.csv")
    assert run(s, ["a=add(db1.t.col1,db1.u.col2)", "x=sum(a)", "print(x)"]) == [str(4 * sum(range(40)))]
    run(s, ["p=select(db1.t.col1,3,9)", "f=fetch(db1.t.col2,p)"])
    plan = s.rows("f")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" not in plan
    assert run(s, ["print(db1.t.col2,db1.u.col1)"])[:2] == ["0,0", "2,1"] and run(s, ["print(f)"]) == text(np.arange(3, 9) * 2)


def test_single_core_holds_for_what_is_asked_in_it(tmp_path, s, data):
    table(s, "t", data[:2], tmp_path / "a.csv")
    run(s, ["single_core()", "p=select(db1.t.col1,0,100)", "f=fetch(db1.t.col2,p)", "x=sum(f)"])
    assert s.numbers["x"].single and s.rows("f").rdd.getNumPartitions() == 1
    m = (data[0] >= 0) & (data[0] < 100)
    assert run(s, ["print(f)", "single_core_execute()", "print(x)"]) == [*text(data[1][m]), str(data[1][m].sum())]


def test_inserts_outlive_the_process(spark, tmp_path, s):
    """Nothing is flushed or shut down here: a new session on the same folder is what is left after a crash."""
    again = lambda: Session(spark, str(tmp_path / "db"))
    show = ["print(db1.t.col1,db1.t.col2)"]
    run(s, ['create(tbl,"t",db1,2)', 'create(col,"col1",db1.t)', 'create(col,"col2",db1.t)', 'create(tbl,"u",db1,1)', 'create(col,"col1",db1.u)'])
    run(s, ["relational_insert(db1.t,1,-1)", "relational_insert(db1.u,7)", "relational_insert(db1.t,2,-2)"])
    assert run(again(), show) == ["1,-1", "2,-2"]  # this one wrote them to a version, but not u's
    s = again()
    assert run(s, [*show, "print(db1.u.col1)"]) == ["1,-1", "2,-2", "7"]
    assert not s.catalog.journal.exists()
    run(s, ["relational_insert(db1.t,3,-3)"])
    kept = s.catalog.journal.read_text()
    assert run(s, show) == ["1,-1", "2,-2", "3,-3"]
    # lost after the version was saved and before the journal was cleared, within a further line
    s.catalog.journal.write_text(kept + '[9, "t", [4, ')
    s = again()
    assert run(s, ["relational_insert(db1.t,5,-5)", *show]) == ["1,-1", "2,-2", "3,-3", "5,-5"]
    s = again()
    run(s, ["relational_insert(db1.t,6,-6)", 'create(db,"db1")'])
    assert again().catalog.pending == {}


def test_many_waiting_inserts_are_written(tmp_path, s, monkeypatch):
    monkeypatch.setattr("stratum.plans.session.MOST_WAITING", 3)
    table(s, "t", [np.arange(2)], tmp_path / "a.csv")
    run(s, [f"relational_insert(db1.t,{i})" for i in range(10, 17)])
    assert s.catalog.pending == {"t": [(16,)]} and s.catalog.tables["t"].version.rows == 8
    assert run(s, ["print(db1.t.col1)"]) == [str(x) for x in (0, 1, *range(10, 17))]


@pytest.mark.parametrize("indexes", [(), ("col1,sorted,unclustered",)])
def test_versions_have_few_segments(tmp_path, s, indexes, monkeypatch):
    monkeypatch.setattr("stratum.sources.storage.MOST_SEGMENTS", 4)
    table(s, "t", [np.arange(100), np.arange(100) * 2], tmp_path / "a.csv", indexes)
    run(s, ["early=select(db1.t.col1,98,null)", "old=fetch(db1.t.col2,early)"])
    t = s.catalog.tables["t"]
    first = t.version.segments[0].path
    for i in range(100, 112):
        run(s, [f"relational_insert(db1.t,{i},{2 * i})", "x=sum(db1.t.col1)"])
        assert len(t.version.segments) <= 4
    assert t.version.segments[0].path == first  # the large one is not written again for single rows
    got = run(s, ["p=select(db1.t.col1,97,103)", "f=fetch(db1.t.col2,p)", "print(f)", "print(old)", "late=fetch(db1.t.col2,early)", "print(late)", "s=sum(db1.t.col1)", "print(s)"])
    assert got == ["194", "196", "198", "200", "202", "204", "196", "198", "196", "198", str(sum(range(112)))]
