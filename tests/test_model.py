import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.errors import EngineError
from weftline.model import Schema
from weftline.operators.accumulate import Count, Fold, Plain, StreamFold, Sum, accumulate_delta, weighted_average
from weftline.operators.ids import is_dense, nth_id, with_ids
from weftline.operators.ranges import DurationRange, NumberRange, PeriodRange, range_table
from weftline.operators.roll import roll


@pytest.fixture
def s(spark):
    return Schema(spark)


def column(t, name):
    return [r[name] for r in t.df().orderBy("_id").select(name).collect()]


def load(s, name, rows, ddl):
    t = s.create_table(name)
    t.load(s.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {ddl}"), id_column="k")
    return t


def test_calculate(s):
    t = load(s, "T", [(5.0,), (None,), (6.0,)], "A double")
    b = s.create_column("B", t).calculate(lambda p: F.coalesce(2 * p[0] + 1, F.lit(float("nan"))), "A")
    c = s.create_column("C", t).calculate("2 * [A] + 1")
    d = s.create_column("D", t).calculate(lambda p: p[0] + 1 if p[0] is not None and p[0] == p[0] else -1.0, "A", udf=True)
    e = s.create_column("E", t).set_default(9.0).calculate(None)
    s.evaluate()
    assert [str(x) for x in column(t, "B")] == ["11.0", "nan", "13.0"] == [str(x) for x in column(t, "C")]
    assert column(t, "D") == [6.0, -1.0, 7.0] and column(t, "E") == [9.0] * 3
    assert b.dependencies() == [t, t.column("A")] and b in t.column("A").dependents() and e.value(1) == 9.0 and c.has_dependency(t) and d.has_dependency(t)


def test_link_and_paths(s):
    t = load(s, "T", [(5.0, "bbb"), (5.0, "bbb"), (None, None)], "A double, B string")
    t2 = load(s, "T2", [(5.0, "bbb"), (10.0, "ccc"), (None, None)], "A double, B string")
    c = s.create_column("C", t2, t).link(["A", "B"], "A", "B")
    back = s.create_column("Name", t2, kind="string").calculate(lambda p: p[0], "C.B")
    s.evaluate()
    assert column(t2, "C") == [0, -1, 2] and column(t2, "Name") == ["bbb", None, None]
    assert t.column("A") in c.dependencies() and back.has_dependency(t.column("B"))
    with pytest.raises(EngineError):
        s.create_column("D", t2, t).link(["k"], "A")
        s.evaluate()


def test_link_to_ranges(s):
    r = s.create_table("R").range(NumberRange(10.0, 20.0, 5))
    f = load(s, "F", [(float(x),) for x in (-200, 10, 20, 30, 90, 100, 200, "nan")], "A double")
    s.create_column("B", f, r).link("A")
    s.evaluate()
    assert column(f, "B") == [-1, 0, 0, 1, 4, 4, -1, -1]
    rd = s.create_table("RD").range(DurationRange(dt.datetime(2018, 1, 1, 0, 45), dt.timedelta(hours=2), 2))
    times = [dt.datetime(2017, 1, 1), *(dt.datetime(2018, 1, 1, *x) for x in ((0, 45), (1, 46), (2, 45), (2, 45), (3, 45))), dt.datetime(2019, 1, 1), None]
    g = load(s, "G", [(x,) for x in times], "A timestamp")
    s.create_column("B", g, rd).link("A")
    s.evaluate()
    assert column(g, "B") == [-1, 0, 0, 1, 1, 1, -1, -1]


def test_project_to_ranges(s):
    r = s.create_table("R").range(NumberRange(10.0, 20.0, 8))
    f = load(s, "F", [(float(x),) for x in (-200, 10, 20, 30, 90, 100, 110, 160, 260)], "A double")
    s.create_column("B", f, r).project("A")
    s.create_column("N", r).accumulate("B", f, lambda p: Count())
    s.evaluate()
    assert r.length() == 8 and column(f, "B")[6:] == [5, 7, -1] and column(r, "N") == [2, 1, 0, 0, 2, 1, 0, 1]
    rd = s.create_table("RD").range(DurationRange(dt.datetime(2018, 1, 1, 0, 45), dt.timedelta(hours=2), 5))
    g = load(s, "G", [(dt.datetime(2018, 1, 1, *x),) for x in ((2, 50), (0, 45), (4, 45), (9, 45), (12, 45))], "A timestamp")
    s.create_column("B", g, rd).project("A")
    s.evaluate()
    # the first fact opens the table at its interval: earlier facts are late
    assert column(g, "B") == [0, -1, 1, 3, -1] and column(rd, "interval") == [1, 2, 3, 4]


def test_range_tables(spark):
    last = [r.value for r in range_table(spark, NumberRange(10.0, 20.0, 5)).collect()][-1]
    assert last == 90.0
    got = [r.value for r in range_table(spark, DurationRange(dt.datetime(2018, 1, 1, 0, 0, 10), dt.timedelta(seconds=20), 5)).collect()]
    assert got[-1] == dt.datetime(2018, 1, 1, 0, 1, 30)
    assert [r.value for r in range_table(spark, PeriodRange(dt.date(2018, 1, 10), 1, 0, 5)).collect()][-1] == dt.date(2018, 5, 10)
    assert [r.value for r in range_table(spark, PeriodRange(dt.date(2018, 1, 31), 1, 0, 3)).collect()][-1] == dt.date(2018, 3, 28)


def test_period_links(s):
    for months, days in ((1, 0), (0, 10), (1, 3)):
        p = PeriodRange(dt.date(2018, 1, 31), months, days, 6)
        starts = p.starts()
        r = s.create_table(f"R{months}{days}").range(p)
        xs = [dt.date(2018, 1, 1) + dt.timedelta(days=k) for k in range(0, 300, 3)]
        f = load(s, f"F{months}{days}", [(x,) for x in xs], "A date")
        s.create_column("B", f, r).link("A")
        s.evaluate()
        assert column(f, "B") == [next((n for n in range(6) if starts[n] <= x < starts[n + 1]), -1) for x in xs]


def test_product_and_where(s):
    t1, t2 = load(s, "T1", [("v1",), ("v2",)], "C string"), load(s, "T2", [("v1",), ("v2",), ("v3",)], "C string")
    t3 = s.create_table("T3")
    s.create_column("A", t3, t1).noop(True)
    s.create_column("B", t3, t2).noop(True)
    t3.product()
    s.evaluate()
    assert t3.length() == 6 and column(t3, "A") == [0, 0, 0, 1, 1, 1] and column(t3, "B") == [0, 1, 2] * 2
    t3.product(lambda p: (p("A.C") == "v1") | (p("B.C") == "v1"))
    s.evaluate()
    assert t3.length() == 4 and column(t3, "_id") == [0, 1, 2, 3]
    t3.product(lambda p: p("C") == 1)
    with pytest.raises(EngineError):
        s.evaluate()


def test_project(s):
    t3 = s.create_table("T3")
    s.create_column("A", t3, kind="bigint").noop(True)
    s.create_column("B", t3, kind="bigint").noop(True)
    t3.product()
    t4 = load(s, "T4", [(1, 2), (1, 1), (1, 2), (2, 2)], "C bigint, D bigint")
    c = s.create_column("L", t4, t3).project(["C", "D"])
    s.evaluate()
    assert column(t4, "L") == [0, 1, 0, 2] and list(zip(column(t3, "A"), column(t3, "B"))) == [(1, 2), (1, 1), (2, 2)]
    t5 = load(s, "T5", [(2, 2), (3, 3)], "C bigint, D bigint")
    s.create_column("L", t5, t3).project(["C", "D"], "A", "B")
    s.evaluate()
    assert column(t5, "L") == [2, 3] and t3.length() == 4 and t3.projections()[0] is c
    t3.product(lambda p: p("B") == 2)
    s.evaluate()
    assert t3.length() == 2 and column(t4, "L") == [0, -1, 0, 1]
    with pytest.raises(EngineError):
        s.create_column("M", t5, t4).project(["C"], "C")


def test_accumulate(s):
    t = load(s, "T", [(5,), (10,), (15,)], "Id int")
    f = load(s, "F", [(5,), (5,), (10,), (20,)], "Id int")
    s.create_column("G", f, t).link("Id", "Id")
    s.create_column("N", t).set_default(0.0).accumulate("G", f, lambda p: Sum(p[0]), "Id")
    s.create_column("D", t).set_default(1.0).accumulate("G", f, lambda p: Count())
    s.create_column("W", t).accumulate("G", f, lambda p: weighted_average(p[0], p[0]), "Id")
    s.create_column("X", t).set_default(2.0).accumulate("G", f, lambda p: Fold(lambda a, q: a * 2 + q[0], tuple(p)), "Id")
    s.create_column("Y", t).set_default(2.0).accumulate("G", f, lambda p: StreamFold(lambda a, q: a * 2 + q, tuple(p)), "Id")
    s.create_column("Z", t).set_default(0.0).accumulate("G", f, "[out] + 2 * [Id]")
    s.evaluate()
    assert column(t, "N") == [10, 10, 0] and column(t, "D") == [3, 2, 1] and column(t, "W") == [5, 10, 0]
    assert column(t, "X") == column(t, "Y") == [23, 14, 2] and column(t, "Z") == [20, 20, 0]
    for step, want in (("add", [10, 20, 0]), (1, [5, 20, 0]), (2, [0, 10, 0])):
        f.add([{"Id": 10}]) if step == "add" else f.remove(step)
        s.evaluate()
        assert column(t, "N") == want
    f.add([{"Id": 15}])
    s.evaluate()
    assert column(t, "N") == [0, 10, 15]


def test_delta_equals_recomputing(spark):
    groups = spark.createDataFrame([(0, 7.0), (1, 2.0), (2, 0.0)], "_id long, total double")
    added = spark.createDataFrame([(0, 1.0), (0, 2.0), (-1, 9.0), (None, 9.0)], "g long, v double")
    removed = spark.createDataFrame([(1, 2.0)], "g long, v double")
    got = accumulate_delta(groups, "total", F.col("g"), Sum(F.col("v")), added, removed)
    assert sorted(map(tuple, got.collect())) == [(0, 10.0), (1, 0.0), (2, 0.0)]


def test_rolls(s):
    f = load(s, "F", [(1.0, 0), (2.0, 1000), (3.0, 1100), (2.0, 1200), (1.0, 2000)], "M double, D bigint")
    s.create_column("R", f).roll(2, 0, "M", step=lambda a, d, p: a + p[0] / (d + 1))
    s.create_column("Q", f).roll(1000, 0, "M", how=lambda p: F.sum(p[0]), distance="D")
    s.create_column("V", f).roll(2, 1, "M", how=lambda p: F.sum(p[0]))
    s.create_column("E", f).set_default(-1.0).roll(0, 0, "M", how=lambda p: F.sum(p[0]))
    s.create_column("U", f).roll(0, 1, "M", how=lambda p: F.sum(p[0]))
    s.create_column("X", f).roll(1000, 0, "M", step=lambda a, d, p: a + p[0] * d, distance="D")
    s.evaluate()
    assert column(f, "R") == [1, 2.5, 4, 3.5, 2] and column(f, "Q") == [1, 2, 5, 7, 6]
    assert column(f, "V") == [3, 6, 7, 6, 3] and column(f, "E") == [-1] * 5 and column(f, "U") == [2, 3, 2, 1, 0]
    assert column(f, "X") == [0, 0, 200, 700, 3 * 900 + 2 * 800]


def test_blocks_change_nothing(spark):
    from weftline.operators.roll import roll, roll_by

    df = spark.range(500).select(F.col("id").alias("_id"), (F.col("id") * 7 % 31).cast("double").alias("v"), (F.col("id") * 3 + F.col("id") % 2).alias("d"))
    for past, future in ((5, 0), (3, 4), (40, 2)):
        a, b = (roll(df, past, future, "r", how=F.sum("v"), rows_per_block=n).orderBy("_id").collect() for n in (50, 10_000))
        assert a == b
    a, b = (roll_by(df, F.col("d"), 20, 5, "r", how=F.sum("v"), windows_per_block=n).orderBy("_id").collect() for n in (1, 1000))
    assert a == b


def test_ids(spark):
    df = spark.range(3000, numPartitions=7).select((F.col("id") * 1777 % 3000).alias("k"), F.concat(F.lit("s"), F.col("id")).alias("s"))
    for order in (["k"], ["s"]):
        rows = with_ids(df, order, start=5).orderBy("_id").collect()
        assert [r["_id"] for r in rows] == list(range(5, 3005)) and [r[order[0]] for r in rows] == sorted(r[order[0]] for r in rows)
    assert with_ids(df.limit(0), ["k"]).count() == 0
    same = with_ids(df.select(F.lit(1).alias("k"), F.lit("x").alias("s")), ["k"])  # ties throughout
    assert sorted(r[0] for r in same.select("_id").collect()) == list(range(3000))
    gaps = df.select((F.col("k") * 13 + 4).alias("_id"))
    assert not is_dense(gaps) and is_dense(gaps.limit(1)) and is_dense(gaps.limit(0))
    assert [nth_id(gaps, n, cuts=16) for n in (0, 1, 777, 2999, 3000)] == [4, 17, 777 * 13 + 4, 2999 * 13 + 4, None]


def test_a_table_of_one_row_grows(spark, s):
    t = s.create_table("T").load(spark.createDataFrame([(7,)], "A int"))
    assert t.add([{"A": 8}]) == (1, 2) and t.add(spark.createDataFrame([(9,), (10,)], "A int")) == (2, 4)
    s.evaluate()
    assert column(t, "_id") == [0, 1, 2, 3] and column(t, "A") == [7, 8, 9, 10]


def test_gapped_ids(spark, s):
    rows = [(i * 10, float(i % 7)) for i in range(50)]
    t = s.create_table("T").load(spark.createDataFrame(rows, "k long, v double"), id_column="k")
    s.create_column("n", t).roll(5, 0, "v", how=lambda p: F.count(p[0]))
    s.evaluate()
    assert column(t, "n") == [1.0, 2.0, 3.0, 4.0] + [5.0] * 46
    assert roll(t.data, 5, 0, "n", how=F.count("v"), rows_per_block=100).filter("n < 5").count() == 4
    assert t.remove(20) == (0, 200)
    s.evaluate()
    assert column(t, "_id") == [i * 10 for i in range(20, 50)] and column(t, "n") == [1.0, 2.0, 3.0, 4.0] + [5.0] * 26


def test_sums_follow_what_comes_and_goes(spark, s):
    users = load(s, "Users", [("a",), ("b",), ("c",)], "name string")
    facts = s.create_table("Facts")
    s.create_column("who", facts, kind="string")
    s.create_column("v", facts)
    s.create_column("user", facts, users).link("who", "name")
    s.create_column("total", users).set_default(1.0).accumulate("user", facts, lambda p: Sum(p[0]), "v", incremental=True)
    s.create_column("n", users, kind="bigint").set_default(0).accumulate("user", facts, lambda p: Count(), incremental=True)
    s.create_column("plain", users).set_default(1.0).accumulate("user", facts, lambda p: Sum(p[0]), "v")
    facts.add([{"who": w, "v": v} for w, v in (("a", 1.0), ("b", 2.0), ("a", 4.0), ("x", 9.0))])
    s.evaluate()
    assert column(users, "total") == [6.0, 3.0, 1.0] and column(users, "n") == [2, 1, 0]
    facts.remove(1)
    facts.add([{"who": "c", "v": 8.0}, {"who": "b", "v": 0.5}])
    s.evaluate()
    assert column(users, "total") == column(users, "plain") == [5.0, 3.5, 9.0] and column(users, "n") == [1, 2, 1]
    facts.add([{"who": "a", "v": 100.0}])
    facts.remove(6)  # the new row comes and goes unseen
    s.evaluate()
    assert column(users, "total") == column(users, "plain") == [1.0, 1.0, 1.0]
    users.set_row(1, {"name": "a"})  # a changed target: everything anew
    facts.add([{"who": "a", "v": 3.0}])
    s.evaluate()
    assert column(users, "total") == column(users, "plain") == [4.0, 1.0, 1.0]


def test_products_join_instead_of_crossing(spark, s):
    a = load(s, "A", [(i % 5, float(i)) for i in range(40)], "x int, y double")
    b = load(s, "B", [(i % 7,) for i in range(30)], "x int")
    p = s.create_table("P")
    s.create_column("a", p, a).noop(True)
    s.create_column("b", p, b).noop(True)
    p.product(lambda q: (q("a.x") == q("b.x")) & (q("a.y") > 10))
    s.evaluate()
    want = [(i, j) for i in range(11, 40) for j in range(30) if i % 5 == j % 7]
    assert [(r["a"], r["b"]) for r in p.df().orderBy("_id").collect()] == want and column(p, "_id") == list(range(len(want)))


def test_formulas_that_add_are_sums(s):
    items = load(s, "Items", [(0, 2.0), (0, 3.0), (1, 5.0)], "ord bigint, v double")
    orders = load(s, "Orders", [(0,), (1,), (2,)], "id bigint")
    s.create_column("O", items, orders).link("ord", "id")
    for name, f in (("A", "[out] + 2 * [v]"), ("B", "[v] + [out] - 1"), ("C", "[out] * 2 + [v]"), ("D", "[out] - [v]"), ("E", "[v] - [out]")):
        s.create_column(name, orders).set_default(1.0).accumulate("O", items, f)
    s.evaluate()
    assert [column(orders, c) for c in "ABCDE"] == [[11.0, 11.0, 1.0], [4.0, 5.0, 1.0], [11.0, 7.0, 1.0], [-4.0, -4.0, 1.0], [2.0, 4.0, 1.0]]
    plan = s.spark._jvm.PythonSQLUtils.explainString(orders.df().select("A", "B", "D")._jdf.queryExecution(), "simple")
    assert "collect_list" not in plan


def test_data_operations(s):
    t = load(s, "T", [(float(i), dt.datetime(2018, 1, 1, 0, i)) for i in range(1, 6)], "C1 double, C2 timestamp")
    assert t.remove_below("C1", 3.0) == 2 and t.remove_below("C2", dt.datetime(2018, 1, 1, 0, 4)) == 1
    s.evaluate()
    assert column(t, "_id") == [3, 4] and t.find({"C1": 5.0}) == 4 and t.find({"C1": 1.0}) == -1
    assert t.add([{"C1": 7.0}]) == (5, 6) and t.remove(1) == (3, 4)
    t.set_row(4, {"C1": 9.0})
    t.column("C2").set_values(None, F.col("_id") == 4)
    s.evaluate()
    assert t.row(4, ["C1", "C2"]) == {"C1": 9.0, "C2": None} and column(t, "_id") == [4, 5]
    assert t.remove() == (4, 6)
    s.evaluate()
    assert t.length() == 0
    t.reset()
    assert t.add([{"C1": 1.0}]) == (0, 1)


def test_catalog_rules(s):
    t = load(s, "T", [(1.0,)], "A double")
    assert s.create_table("T") is t
    b = s.create_column("B", t).calculate("[A] + 1")
    with pytest.raises(EngineError):
        s.create_column("B", t)
    with pytest.raises(EngineError):
        s.delete_column(t.column("A"))
    with pytest.raises(EngineError):
        t.column("A").calculate("[B] + 1")
    assert t.column("A").definition is None
    with pytest.raises(EngineError):
        b.calculate("[Nope] + 1")
    with pytest.raises(EngineError):
        s.create_column("C", t).calculate(lambda p: 1 if p[0] > 0 else 2, "A")
        s.evaluate()
    assert t.column("C").errors
    s.delete_column(t.column("C"))
    u = s.create_table("U")
    s.create_column("L", t, u)
    s.delete_table(u)
    assert [c.name for c in t.columns()] == ["k", "A", "B"]


def test_only_what_is_wanted(s):
    t = load(s, "T", [(1.0,)], "A double")
    b = s.create_column("B", t).calculate("[A] + 1")
    s.create_column("C", t).calculate(lambda p: 1 if p[0] > 0 else 2, "A")  # would fail
    s.evaluate(b)
    assert b.value(0) == 2.0 and "C" not in t.df().columns


def test_aggregate_of_aggregate(s):
    items = load(s, "Items", [(1, 2.0), (1, 3.0), (2, 5.0)], "order bigint, v double")
    orders = load(s, "Orders", [(1, 9), (2, 9)], "id bigint, cust bigint")
    custs = load(s, "Custs", [(9,)], "id bigint")
    s.create_column("O", items, orders).link("order", "id")
    s.create_column("C", orders, custs).link("cust", "id")
    s.create_column("T", orders).accumulate("O", items, lambda p: Sum(p[0]), "v")
    s.create_column("M", custs).accumulate("C", orders, lambda p: Plain(F.max(p[0])), "T")
    s.create_column("S", custs).accumulate("O.C", items, lambda p: Sum(p[0]), "v")
    s.evaluate()
    assert custs.row(0)["M"] == 5.0 and custs.row(0)["S"] == 10.0


def test_views_bounds_and_changes(s):
    t = load(s, "Things", [(1.0,), (4.0,), (4.0,)], "A double")
    s.create_column("B", t).calculate("[A] * 2")
    assert t.is_changed()
    s.evaluate()
    s.create_views("v_")
    assert s.spark.sql("SELECT sum(B) FROM v_Things").first()[0] == 18.0 and not t.is_changed()
    assert t.column("B").lower_bound(8.0) == 1 and t.column("B").lower_bound(9.0) == -1 and t.id_range() == (0, 3)
    t.add([{"A": 9.0}])
    t.remove(2)
    assert t.changes() == ((3, 4), (0, 2)) and t.is_changed()
    s.evaluate()
    assert t.changes() == ((4, 4), (2, 2)) and t.id_range() == (2, 4)
