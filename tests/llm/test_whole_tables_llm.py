import __spark_entry__ as entry


def test_pairs_that_meet_once_are_given(spark, tmp_path):
    """A pair in one order only comes out with its figures, and may be significant."""
    rows = [(o, p) for o in range(100) for p in (1, 2 + o % 3)] + [(500, 77), (500, 78), (501, None), (None, 77)]
    spark.createDataFrame(rows, "order_id long, product_id long").write.parquet(f"{tmp_path}/order_items.parquet")
    got = {(r.product_a, r.product_b): r for r in entry.queries()["p4_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (77, 78)}
    r = got[77, 78]
    assert (r.orders_both, r.orders_a, r.orders_b) == (1, 1, 1) and r.lift == 101 and r.llr > 10.828  # 101 orders hold a product
