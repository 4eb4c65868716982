import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import cooccur
from weftline.llm.cooccur import Stripes, cooccurrence, pair_blocks


def brute(rows):
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    c, k = Counter(), Counter()
    for s in sets.values():
        c.update(s)
        k.update(itertools.combinations(sorted(s), 2))
    return len(sets), c, k


def llr(k, a, b, n):
    cells = [(k, a * b / n), (a - k, a * (n - b) / n), (b - k, b * (n - a) / n), (n - a - b + k, (n - a) * (n - b) / n)]
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)


def some_rows(seed=1, orders=300, items=30):
    rnd = random.Random(seed)
    rows = [(o, 1 if rnd.random() < 0.4 else rnd.randrange(items)) for o in range(orders) for _ in range(rnd.randrange(1, 6))]
    rows += [(7, i) for i in range(500)]  # a long order
    return rows + rows[:50] + [(None, 3), (4, None), (None, None)]


def test_all_pairs_against_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame([(b, i, "x") for b, i in rows], "o long, p int, k string").repartition(5)
    n, c, k = brute(rows)
    got = {(r.item_a, r.item_b): r for r in cooccurrence(df, "o", "p").collect()}
    assert {p: r.k for p, r in got.items()} == dict(k)
    for (a, b), r in got.items():
        assert (r.c_a, r.c_b, r.n) == (c[a], c[b], n)
        assert math.isclose(r.lift, k[a, b] * n / (c[a] * c[b]))
        assert math.isclose(r.llr, max(0.0, llr(k[a, b], c[a], c[b], n)), abs_tol=1e-6)


def test_early_dropping_changes_nothing(spark):
    rows = some_rows(2)
    df = spark.createDataFrame(rows, "o long, p long")
    n, c, k = brute(rows)
    want = {p for p, x in k.items() if x >= 3 and x * n >= 2 * c[p[0]] * c[p[1]]}
    assert want and {(r.item_a, r.item_b) for r in cooccurrence(df, "o", "p", 3, 2).collect()} == want


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([], "o long, p long")
    assert cooccurrence(df, "o", "p").count() == 0
    df = spark.createDataFrame([(1, 1), (2, 1), (None, 2)], "o long, p long")
    assert cooccurrence(df, "o", "p", 1, 4).count() == 0


def test_long_lists_are_done_in_blocks(monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_ITEMS", 100)
    x = np.sort(np.random.default_rng(0).choice(10_000, 350, replace=False))
    got = [p for a, b in pair_blocks([x, x[:2], x[:1]]) for p in zip(a.tolist(), b.tolist())]
    assert sorted(got) == sorted([*itertools.combinations(x.tolist(), 2), (x[0], x[1])])


def test_stripes_combine():
    s = Stripes()
    s.add(np.array([5, 1, 5]), np.array([9, 2, 9]))
    s.combine()
    s.add(np.array([1, 1]), np.array([2, 9]))
    a, b, n = s.combine()
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 2, 2), (1, 9, 1), (5, 9, 2)]


def test_a_long_basket_is_cut_into_pieces(spark):
    from weftline.llm import cooccur as C

    n = 2 * C.BLOCK_ITEMS + 77
    rows = spark.range(n).select(F.lit(1).alias("o"), F.col("id").alias("p")).unionByName(spark.range(40).select(F.lit(2).alias("o"), (F.col("id") * 60).alias("p")))
    got = C.cooccurrence(rows, "o", "p")
    assert got.count() == n * (n - 1) // 2 + sum(1 for a in range(40) for b in range(a) if 60 * a >= n)
    both = [60 * k for k in range(40) if 60 * k < n]
    assert {(r.item_a, r.item_b) for r in got.filter("k = 2").collect()} == {(a, b) for a in both for b in both if a < b}
