import datetime as dt

from weftline.operators.orphans import ParentTable, Reference, missing_by_period, orphan_rows, orphans_by_period

D = dt.datetime


def tables(spark, children, parents):
    c = spark.createDataFrame(children, "id long, pid long, seen timestamp, ev timestamp, kind string, salt int")
    p = spark.createDataFrame(parents, "key int, up timestamp, gone timestamp, k string")
    return [ParentTable("p", p, "key", "up", "gone")], [Reference("c", c, "id", "pid", "p", "seen", "ev")]


def test_kinds_and_their_order(spark):
    parents = [(1, D(2023, 1, 1), None, "x"), (2, D(2023, 6, 1), D(2023, 7, 1), "x"), (3, None, None, "x"), (None, D(2020, 1, 1), None, "x")]
    children = [
        (1, 1, D(2023, 2, 1), D(2023, 2, 1), "a", 1),  # fine
        (2, 9, D(2023, 2, 1), D(2023, 2, 3), "a", 1),  # missing
        (2, 9, D(2023, 2, 1), D(2023, 2, 3), "a", 1),  # a copy
        (3, 2, D(2023, 5, 1), D(2023, 8, 1), "a", 1),  # late before deleted
        (4, 2, D(2023, 7, 2), D(2023, 7, 1), "a", 1),  # deleted at that moment
        (5, 2, D(2023, 7, 2), D(2023, 6, 30), "a", 1),  # just before
        (6, None, D(2023, 7, 2), D(2023, 6, 30), "a", 1),  # no reference
        (7, 3, D(2020, 1, 1), D(2020, 1, 1), "a", 1),  # loaded nobody knows when
        (8, 2, None, None, "a", 1),  # no times
        (None, 9, None, None, "a", 1),  # no id, no times
    ]
    ps, rs = tables(spark, children, parents)
    got = {(r.row_id, r.kind) for r in orphan_rows(ps, rs).collect()}
    assert got == {(2, "missing"), (3, "late"), (4, "deleted"), (None, "missing")}
    report = {(r.period, r.kind): (r.n_rows, r.n_keys) for r in orphans_by_period(ps, rs).collect()}
    assert report[("2023-02", "missing")] == (1, 1)
    missing = {r.period: (r.n_rows, r.n_keys) for r in missing_by_period(ps, rs).collect()}
    assert missing == {"2023-02": (2, 1), None: (1, 1)}


def test_empty_tables(spark):
    ps, rs = tables(spark, [], [(1, None, None, "x")])
    assert orphan_rows(ps, rs).count() == 0 and missing_by_period(ps, rs).count() == 0
    ps, rs = tables(spark, [(1, 1, D(2023, 1, 1), D(2023, 1, 1), "a", 1)], [])
    assert [(r.row_id, r.kind) for r in orphan_rows(ps, rs).collect()] == [(1, "missing")]


def test_a_hot_key_against_brute_force(spark):
    parents = [(k, D(2023, 1, 1 + k), D(2023, 2, 1 + k) if k % 2 else None, "x") for k in range(5)]
    children = [(i, 0 if i % 3 else i % 7, D(2023, 1, 1 + i % 28), D(2023, 2, 1 + i % 28), "a", 1) for i in range(2000)]
    ps, rs = tables(spark, children, parents)
    by = {p[0]: p for p in parents}
    want = set()
    for i, k, seen, ev, _, _ in children:
        p = by.get(k)
        kind = "missing" if p is None else "late" if p[1] > seen else "deleted" if p[2] and p[2] <= ev else None
        if kind:
            want.add((i, kind))
    assert {(r.row_id, r.kind) for r in orphan_rows(ps, rs).collect()} == want
    # too many suspects to be sent: rows and keys meet by shuffle, the hot key in slices
    assert {(r.row_id, r.kind) for r in orphan_rows(ps, rs, most_sent=0, rows_per_slice=50).collect()} == want
