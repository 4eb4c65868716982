import math

from pyspark.sql import functions as F

from weftline.operators.skew import Measure, heavy_keys, product_totals, tree_aggregate, tree_rounds


def test_rounds_grow_with_the_logarithm():
    assert tree_rounds(1, 32) == 2
    assert tree_rounds(32**3, 32) == 3
    assert tree_rounds(800_000, 32) == 4


def test_equals_a_plain_aggregate_on_hot_keys(spark):
    df = spark.range(20_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("k"), (F.col("id") % 7).cast("double").alias("v")
    )
    ms = [Measure("n", "count"), Measure("s", "sum", F.col("v")), Measure("lo", "min", F.col("v")), Measure("hi", "max", F.col("v"))]
    got = {r[0]: (r[1], float(r[2]), r[3], r[4]) for r in tree_aggregate(df, ["k"], ms, fan_in=2, rounds=5).collect()}
    want = {r[0]: tuple(r[1:]) for r in df.groupBy("k").agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v")).collect()}
    assert got == want


def test_nulls_copies_and_clashing_names(spark):
    rows = [(1, 2.0, 3.0, 9), (1, 2.0, 3.0, 9), (None, 1.0, None, 9), (2, None, 1.0, 9), (3, math.nan, math.inf, 9)]
    df = spark.createDataFrame(rows, "product_id long, quantity double, unit_price double, n_rows int").withColumn("__slot", F.lit(1))
    got = {r.product_id: (r.n_rows, r.total_quantity, r.revenue) for r in product_totals(df).collect()}
    assert got == {1: (2, 4, 12), None: (1, 1, None), 2: (1, None, None), 3: (1, None, None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "product_id long, quantity double, unit_price double")
    assert product_totals(df).count() == 0
    assert heavy_keys(df, "product_id", 40).count() == 0


def test_heavy_keys_counts_nulls_in_the_total(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(None,)] * 4 + [(2,)], "k long")
    assert [(r.k, r.n_rows) for r in heavy_keys(df, "k", 2).collect()] == [(1, 5)]
    assert {r.k for r in heavy_keys(df, "k", 10).collect()} == {1, 2}


def test_sums_lose_no_value(spark):
    rows = [(1, 1e23), (1, 1.0)] + [(2, 1e-7)] * 10 + [(3, 1e300), (3, 1.0)] + [(4, 1e-300)] * 4 + [(5, 1e23), (5, 1.0), (5, -1e23)] + [(6, -0.1)] * 3 + [(7, 5e25), (7, -5e25), (7, 2.0**-40)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {r[0]: r[1] for r in tree_aggregate(df, ["k"], [Measure("s", "sum", F.col("v"))], fan_in=2, rounds=3).collect()}
    assert got == {k: math.fsum(v for j, v in rows if j == k) for k in range(1, 8)}
    df = spark.range(4000, numPartitions=8).select((F.col("id") % 3).alias("k"), ((F.rand(5) - 0.5) * F.pow(F.lit(10.0), F.rand(6) * 40 - 20)).alias("v"))
    rows = df.collect()
    got = {r[0]: r[1] for r in tree_aggregate(spark.createDataFrame(rows), ["k"], [Measure("s", "sum", F.col("v"))], fan_in=2).collect()}
    assert all(math.isclose(got[k], math.fsum(v for j, v in rows if j == k), rel_tol=1e-15) for k in range(3))
