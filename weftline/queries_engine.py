"""Queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import epoch_seconds
from weftline.model import Schema, Table
from weftline.operators.accumulate import Count, Fold, Plain, StreamFold, Sum, accumulate, weighted_average
from weftline.operators.ids import ID
from weftline.operators.ranges import DurationRange, NumberRange, PeriodRange, range_table
from weftline.operators.roll import roll_by
from weftline.session import read_table, scratch_folder
from weftline.sources.replay import file_stream
from weftline.streaming import server as S
from weftline.streaming import windows

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
EVENTS_FROM = dt.datetime(2024, 1, 1)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[Schema, dict[str, Table]]:
    s = Schema(spark)
    out = {}
    for n in names:
        df = read_table(spark, sf_dir, n)
        out[n] = s.create_table(n).load(df, id_column=IDS.get(n), dense=False)
    return s, out


def sales(spark: SparkSession, sf_dir: str) -> tuple[Schema, dict[str, Table]]:
    """Orders, customers, nations and regions with their links."""
    s, t = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    s.create_column("customer", t["orders"], t["customer"]).link("o_custkey", "c_custkey")
    s.create_column("nation", t["customer"], t["nation"]).link("c_nationkey", "n_nationkey")
    s.create_column("region", t["nation"], t["region"]).link("n_regionkey", "r_regionkey")
    return s, t


def calc_revenue(spark, sf_dir):
    s, t = tables(spark, sf_dir, "lineitem")
    c = s.create_column("revenue", t["lineitem"]).calculate(lambda p: p[0] * (1 - p[1]), "l_extendedprice", "l_discount")
    s.evaluate(c)
    return t["lineitem"].df().select("l_orderkey", "l_linenumber", "l_partkey", F.round("revenue", 4).alias("revenue"))


def calc_path(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.create_column("nation_name", t["orders"], kind="string").calculate(lambda p: p[0], "customer.nation.n_name")
    s.create_column("region_name", t["orders"], kind="string").calculate(lambda p: F.upper(p[0]), "customer.nation.region.r_name")
    s.evaluate(t["orders"].column("nation_name"), t["orders"].column("region_name"))
    return t["orders"].df().select("o_orderkey", "nation_name", "region_name")


def calc_udf(spark, sf_dir):
    s, t = tables(spark, sf_dir, "part")
    s.create_column("size_class", t["part"], kind="string").calculate(lambda p: "small" if p[0] < 10 else "large" if p[0] > 40 else "middle", "p_size", udf=True)
    s.evaluate()
    return t["part"].df().select("p_partkey", "size_class")


def calc_series(spark, sf_dir):
    """A function over whole batches, as pandas Series."""
    s, t = tables(spark, sf_dir, "part")
    s.create_column("size_class", t["part"], kind="string").calculate(lambda p: pd.cut(p[0], [-1, 9, 40, 1 << 30], labels=["small", "middle", "large"]).astype(str), "p_size", udf="series")
    s.evaluate()
    return t["part"].df().select("p_partkey", "size_class")


def link_customer(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.evaluate(t["orders"].column("customer"))
    return t["orders"].df().select("o_orderkey", "customer")


def link_missing(spark, sf_dir):
    s, t = tables(spark, sf_dir, "orders", "customer")
    t["customer"].replace(t["customer"].data.filter("c_acctbal > 0"))
    s.create_column("customer", t["orders"], t["customer"]).link("o_custkey", "c_custkey")
    s.evaluate()
    return t["orders"].df().select("o_orderkey", "customer")


def link_first_duplicate(spark, sf_dir):
    s, t = tables(spark, sf_dir, "orders", "customer")
    s.create_column("first_order", t["customer"], t["orders"]).link("c_custkey", "o_custkey")
    s.evaluate()
    return t["customer"].df().select("c_custkey", "first_order")


def link_nullsafe(spark, sf_dir):
    s, t = tables(spark, sf_dir, "part", "supplier")
    s.create_column("k", t["part"], kind="bigint").calculate(lambda p: F.nullif(p[0].cast("bigint") % 7, F.lit(3).cast("bigint")), "p_size")
    s.create_column("k", t["supplier"], kind="bigint").calculate(lambda p: F.nullif(p[0] % 7, F.lit(5).cast("bigint")), "s_suppkey")
    s.create_column("to", t["part"], t["supplier"]).link("k", "k")
    s.evaluate()
    return t["part"].df().select("p_partkey", F.col("to").alias("supplier"))


def link_two_keys(spark, sf_dir):
    s, t = tables(spark, sf_dir, "customer", "supplier")
    s.create_column("band", t["customer"], kind="bigint").calculate(lambda p: F.floor(p[0] / 1000), "c_acctbal")
    s.create_column("band", t["supplier"], kind="bigint").calculate(lambda p: F.floor(p[0] / 1000), "s_acctbal")
    s.create_column("peer", t["customer"], t["supplier"]).link(["c_nationkey", "band"], "s_nationkey", "band")
    s.evaluate()
    return t["customer"].df().select("c_custkey", "peer")


def link_range_number(spark, sf_dir):
    s, t = tables(spark, sf_dir, "part")
    r = s.create_table("bands").range(NumberRange(950.0, 100.0, 8))
    s.create_column("band", t["part"], r).link("p_retailprice")
    s.evaluate()
    return t["part"].df().select("p_partkey", "band")


def link_range_duration(spark, sf_dir):
    s, t = tables(spark, sf_dir, "events")
    r = s.create_table("parts").range(DurationRange(EVENTS_FROM + dt.timedelta(hours=7), dt.timedelta(hours=6), 40))
    s.create_column("part", t["events"], r).link("ts")
    s.evaluate()
    return t["events"].df().select("event_id", "part")


def link_range_period(spark, sf_dir):
    s, t = tables(spark, sf_dir, "orders")
    r = s.create_table("months").range(PeriodRange(dt.date(1993, 3, 1), 1, 0, 40))
    s.create_column("month", t["orders"], r).link("o_orderdate")
    s.evaluate()
    return t["orders"].df().select("o_orderkey", "month")


def project_distinct(spark, sf_dir):
    s, t = tables(spark, sf_dir, "part")
    brands = s.create_table("brands")
    s.create_column("name", brands, kind="string").noop(True)
    brands.product()
    s.create_column("brand", t["part"], brands).project("p_brand", "name")
    s.create_column("n_parts", brands, kind="bigint").set_default(0).accumulate("brand", t["part"], lambda p: Count())
    s.evaluate()
    return brands.df().select(F.col(ID).alias("brand_id"), "name", "n_parts")


def project_where(spark, sf_dir):
    s, t = tables(spark, sf_dir, "part")
    kinds = s.create_table("kinds")
    s.create_column("brand", kinds, kind="string").noop(True)
    s.create_column("size", kinds, kind="int").noop(True)
    kinds.product(lambda p: (p("size") > 40) & (p("brand") != "Brand#11"))
    s.create_column("of_kind", t["part"], kinds).project(["p_brand", "p_size"])
    s.evaluate()
    return t["part"].df().select("p_partkey", "of_kind")


def project_range_gaps(spark, sf_dir):
    """All events by stretches of twenty seconds, many of which have none."""
    s, t = tables(spark, sf_dir, "events")
    r = s.create_table("stretches").range(DurationRange(EVENTS_FROM - dt.timedelta(days=1), dt.timedelta(seconds=20), 10_000_000))
    s.create_column("stretch", t["events"], r).project("ts")
    s.create_column("total", r).set_default(0.0).accumulate("stretch", t["events"], lambda p: Sum(p[0]), "value")
    s.evaluate()
    return r.df().select(F.col(ID).alias("stretch_id"), "interval", F.round("total", 4).alias("total"))


def project_range_seconds(spark, sf_dir):
    """All events by second: most seconds have none, so the range itself makes the gaps."""
    s, t = tables(spark, sf_dir, "events")
    r = s.create_table("seconds").range(DurationRange(EVENTS_FROM - dt.timedelta(days=1), dt.timedelta(seconds=1), 100_000_000))
    s.create_column("second", t["events"], r).project("ts")
    s.create_column("total", r).set_default(0.0).accumulate("second", t["events"], lambda p: Sum(p[0]), "value")
    s.evaluate()
    return r.df().select(F.col(ID).alias("second_id"), "interval", F.round("total", 4).alias("total"))


def accumulate_customer(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    c, o = t["customer"], t["orders"]
    s.create_column("total", c).set_default(0.0).accumulate("customer", o, lambda p: Sum(p[0]), "o_totalprice")
    s.create_column("n", c, kind="bigint").set_default(0).accumulate("customer", o, lambda p: Count())
    s.create_column("largest", c).set_default(-1.0).accumulate("customer", o, lambda p: Plain(F.max(p[0])), "o_totalprice")
    s.create_column("mean", c).calculate(lambda p: F.when(p[1] > 0, p[0] / p[1]).otherwise(0.0), "total", "n")
    s.evaluate(c.column("mean"), c.column("largest"))
    return c.df().select("c_custkey", F.round("total", 2).alias("total"), "n", "largest", F.round("mean", 4).alias("mean"))


def accumulate_path(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.create_column("total", t["region"]).accumulate("customer.nation.region", t["orders"], lambda p: Sum(p[0]), "o_totalprice")
    s.create_column("total", t["nation"]).accumulate("customer.nation", t["orders"], lambda p: Sum(p[0]), "o_totalprice")
    s.create_column("share", t["nation"]).calculate(lambda p: p[0] / p[1], "total", "region.total")
    s.evaluate()
    return t["nation"].df().select("n_name", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


def accumulate_of_accumulate(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.create_column("total", t["customer"]).accumulate("customer", t["orders"], lambda p: Sum(p[0]), "o_totalprice")
    s.create_column("best", t["nation"]).accumulate("nation", t["customer"], lambda p: Plain(F.max(p[0])), "total")
    s.create_column("weighted", t["nation"]).accumulate("nation", t["customer"], lambda p: weighted_average(p[0], p[1]), "c_acctbal", "total")
    s.evaluate()
    return t["nation"].df().select("n_name", F.round("best", 2).alias("best"), F.round("weighted", 4).alias("weighted"))


def accumulate_retract(spark, sf_dir):
    """Totals brought up to date when the older half of the orders goes, without reading the other half again."""
    s, t = sales(spark, sf_dir)
    orders = t["orders"]
    c = s.create_column("total", t["customer"]).accumulate("customer", orders, lambda p: Sum(p[0]), "o_totalprice", remover=lambda p: Sum(-p[0]))
    s.evaluate(c)
    orders.remove_below("o_orderkey", (orders.id_range()[1] - 1) // 2)
    s.evaluate(c)
    return t["customer"].df().select("c_custkey", (F.round("total", 2) + 0.0).alias("total"))


def accumulate_fold(spark, sf_dir):
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").alias(ID)).distinct()
    events = read_table(spark, sf_dir, "events").withColumn(ID, F.col("event_id"))
    got = accumulate(users, events, F.col("user_id"), Fold(lambda a, p: a * 0.5 + p[0], (F.col("value"),)), "level", 0.0)
    got = accumulate(got, events, F.col("user_id"), StreamFold(lambda a, x: a * 0.5 + x, (F.col("value"),)), "streamed", 0.0)
    return got.select(F.col(ID).alias("user_id"), F.round("level", 4).alias("level"), F.round("streamed", 4).alias("streamed"))


def _rolled(spark, sf_dir, *args, **kw):
    s, t = tables(spark, sf_dir, "events")
    s.create_column("r", t["events"]).roll(*args, **kw)
    s.evaluate()
    return t["events"].df().select("event_id", F.round("r", 4).alias("r"))


def roll_rows(spark, sf_dir):
    return _rolled(spark, sf_dir, 7, 0, "value", how=lambda p: F.sum(p[0]))


def roll_future(spark, sf_dir):
    return _rolled(spark, sf_dir, 3, 2, "value", how=lambda p: F.max(p[0]))


def roll_weighted(spark, sf_dir):
    return _rolled(spark, sf_dir, 5, 0, "value", step=lambda a, d, p: a + p[0] / (d + 1))


def roll_smooth(spark, sf_dir):
    weights = sum(2.718281828459045**-k for k in range(4))
    return _rolled(spark, sf_dir, 4, 0, "value", step=lambda a, d, p: a + p[0] * F.exp(-d) / weights)


def roll_mean(spark, sf_dir):
    """A moving average with a fixed divisor, also where fewer rows exist."""
    return _rolled(spark, sf_dir, 10, 0, "value", how=lambda p: F.sum(p[0] / 10.0))


def roll_diff(spark, sf_dir):
    return _rolled(spark, sf_dir, 2, 0, "value", step=lambda a, d, p: F.when(d == 0, a + p[0]).when(d == 1, a - p[0]).otherwise(a))


def roll_time(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").withColumn(ID, F.col("event_id"))
    got = roll_by(ev, epoch_seconds(F.col("ts")), 3600, 0, "r", how=F.sum("value"), scale=1_000_000)
    return got.select("event_id", F.round("r", 4).alias("r"))


def product_all(spark, sf_dir):
    s, t = tables(spark, sf_dir, "region", "nation")
    p = s.create_table("pairs")
    s.create_column("r", p, t["region"]).noop(True)
    s.create_column("n", p, t["nation"]).noop(True)
    p.product()
    s.evaluate()
    return p.df().select(F.col(ID).alias("pair_id"), "r", "n")


def product_where(spark, sf_dir):
    s, t = tables(spark, sf_dir, "nation", "supplier")
    p = s.create_table("pairs")
    s.create_column("n", p, t["nation"]).noop(True)
    s.create_column("s", p, t["supplier"]).noop(True)
    p.product(lambda q: (q("n.n_nationkey") == q("s.s_nationkey")) & (q("s.s_acctbal") > 5000))
    s.evaluate()
    return p.df().select(F.col(ID).alias("pair_id"), "n", "s")


def range_number(spark, sf_dir):
    return range_table(spark, NumberRange(10.0, 2.5, 1000)).select(ID, "value")


def range_duration(spark, sf_dir):
    return range_table(spark, DurationRange(EVENTS_FROM, dt.timedelta(minutes=20), 500)).select(ID, F.unix_micros("value").alias("micros"))


def range_period(spark, sf_dir):
    return range_table(spark, PeriodRange(dt.date(2018, 1, 10), 1, 0, 60)).select(ID, F.date_format("value", "yyyy-MM-dd").alias("day"))


def vwap_hourly(spark, sf_dir):
    s, t = tables(spark, sf_dir, "events")
    r = s.create_table("hours").range(DurationRange(EVENTS_FROM, dt.timedelta(hours=1), 1_000_000))
    s.create_column("hour", t["events"], r).project("ts")
    s.create_column("weight", t["events"]).calculate(lambda p: (p[0] % 10 + 1).cast("double"), "user_id")
    s.create_column("vwap", r).set_default(0.0).accumulate("hour", t["events"], lambda p: weighted_average(p[0], p[1]), "value", "weight")
    s.create_column("n", r, kind="bigint").set_default(0).accumulate("hour", t["events"], lambda p: Count())
    s.evaluate()
    return r.df().select("interval", F.round("vwap", 7).alias("vwap"), "n")


def tumble_then_roll(spark, sf_dir):
    """Hourly sums, then a mean over the last three hours."""
    s, t = tables(spark, sf_dir, "events")
    r = s.create_table("hours").range(DurationRange(EVENTS_FROM, dt.timedelta(hours=1), 1_000_000))
    s.create_column("hour", t["events"], r).project("ts")
    s.create_column("total", r).set_default(0.0).accumulate("hour", t["events"], lambda p: Sum(p[0]), "value")
    s.create_column("smooth", r).roll(3, 0, "total", how=lambda p: F.sum(p[0] / 3.0))
    s.evaluate()
    return r.df().select("interval", F.round("total", 4).alias("total"), F.round("smooth", 4).alias("smooth"))


def window_tumbling(spark, sf_dir):
    got = windows.tumbling(read_table(spark, sf_dir, "events"), "ts", "30 minutes", F.count("*").alias("n"), F.sum("value").alias("total"), keys=["event_type"])
    return got.select(F.unix_micros("start").alias("start_micros"), "event_type", "n", F.round("total", 4).alias("total"))


def window_sessions(spark, sf_dir):
    got = windows.sessions(read_table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"), F.max("value").alias("top"))
    return got.select(F.unix_micros("start").alias("start_micros"), "user_id", "n", "top")


def retention_count(spark, sf_dir):
    s, t = tables(spark, sf_dir, "events")
    S.Server(s).submit([S.keep_last(t["events"], 500), S.evaluate])
    return t["events"].df().select("event_id", "value")


def retention_age(spark, sf_dir):
    s, t = tables(spark, sf_dir, "events")
    now = EVENTS_FROM + dt.timedelta(days=4)
    S.Server(s).submit([S.drop_older(t["events"], "ts", dt.timedelta(hours=36), lambda: now), S.evaluate])
    return t["events"].df().select("event_id", "value")


def stream_totals(spark, sf_dir):
    """Events that arrive as a stream of files are appended and linked to their hour; the totals are what the last batch left."""
    folder = scratch_folder(spark, "stream")
    s = Schema(spark)
    events, kinds = s.create_table("events"), s.create_table("kinds")
    for name, kind in (("event_id", "bigint"), ("event_type", "string"), ("value", "double")):
        s.create_column(name, events, kind=kind)
    s.create_column("name", kinds, kind="string").noop(True)
    kinds.product()
    s.create_column("of_kind", events, kinds).project("event_type", "name")
    s.create_column("n", kinds, kind="bigint").set_default(0).accumulate("of_kind", events, lambda p: Count())
    s.create_column("total", kinds).set_default(0.0).accumulate("of_kind", events, lambda p: Sum(p[0]), "value")
    schema = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value").schema
    stream = file_stream(spark, sf_dir, schema, "parquet", pathGlobFilter="events.parquet")
    S.Server(s, f"{folder}/tables").start(stream, [S.add(events), S.evaluate], f"{folder}/progress").awaitTermination()
    s.evaluate()
    return kinds.df().select("name", "n", F.round("total", 2).alias("total"))


def formula_calc(spark, sf_dir):
    s, t = tables(spark, sf_dir, "lineitem")
    s.create_column("charge", t["lineitem"]).calculate("[l_extendedprice] * (1 - [l_discount]) * (1 + [l_tax]) + sqrt([l_quantity]) ^ 2")
    s.evaluate()
    return t["lineitem"].df().select("l_orderkey", "l_linenumber", "l_partkey", F.round("charge", 6).alias("charge"))


def formula_path(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.create_column("gap", t["orders"]).calculate("[o_totalprice] - [customer].[c_acctbal]")
    s.evaluate()
    return t["orders"].df().select("o_orderkey", F.round("gap", 4).alias("gap"))


def formula_fold(spark, sf_dir):
    s, t = sales(spark, sf_dir)
    s.create_column("twice", t["customer"]).set_default(1.0).accumulate("customer", t["orders"], "[out] + 2 * [o_totalprice]")
    s.evaluate()
    return t["customer"].df().select("c_custkey", F.round("twice", 2).alias("twice"))


def semi_anti(spark, sf_dir):
    """Customers with and without orders, from links alone."""
    s, t = tables(spark, sf_dir, "orders", "customer")
    s.create_column("first_order", t["customer"], t["orders"]).link("c_custkey", "o_custkey")
    s.create_column("has_orders", t["customer"], kind="boolean").calculate(lambda p: p[0] >= 0, "first_order")
    s.evaluate()
    return t["customer"].df().groupBy("has_orders").agg(F.count("*").alias("n"))


def nation_revenue(spark, sf_dir):
    """Revenue per nation: line items through orders and customers."""
    s, t = sales(spark, sf_dir)
    items = s.create_table("lineitem").load(read_table(spark, sf_dir, "lineitem"), dense=False)
    s.create_column("order", items, t["orders"]).link("l_orderkey", "o_orderkey")
    s.create_column("revenue", items).calculate("[l_extendedprice] * (1 - [l_discount])")
    s.create_column("revenue", t["nation"]).accumulate("order.customer.nation", items, lambda p: Sum(p[0]), "revenue")
    s.evaluate()
    return t["nation"].df().select("n_name", F.round("revenue", 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        nation_revenue, calc_revenue, calc_path, calc_udf, calc_series, link_customer, link_missing, link_first_duplicate, link_nullsafe, link_two_keys, link_range_number, link_range_duration, link_range_period,
        project_distinct, project_where, project_range_gaps, project_range_seconds, accumulate_customer, accumulate_path, accumulate_of_accumulate, accumulate_retract, accumulate_fold,
        roll_rows, roll_future, roll_weighted, roll_smooth, roll_mean, roll_diff, roll_time, product_all, product_where, range_number, range_duration, range_period, vwap_hourly, tumble_then_roll,
        window_tumbling, window_sessions, stream_totals, retention_count, retention_age, formula_calc, formula_path, formula_fold, semi_anti,
    )
}

_SALES = "orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"
_HOUR = "CAST(floor(epoch_us(ts) / 3600000000) - floor(epoch_us(TIMESTAMP '2024-01-01') / 3600000000) AS BIGINT)"
_HOURS = f"""
WITH h AS (SELECT {_HOUR} AS hour, value, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01'),
f AS (SELECT {_HOUR} AS first FROM events WHERE ts >= TIMESTAMP '2024-01-01' ORDER BY event_id LIMIT 1),
r AS (SELECT unnest(generate_series((SELECT first FROM f), (SELECT max(hour) FROM h))) AS interval),
"""
_FRAME = "over (ORDER BY event_id ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
_LAG = "coalesce(lag(value, {0}) OVER (ORDER BY event_id), 0)"

SQL = {
    "nation_revenue": f"""SELECT n_name, round(coalesce(v, 0), 2) AS revenue FROM nation LEFT JOIN (SELECT n.n_nationkey AS k, sum(l_extendedprice * (1 - l_discount)) AS v
        FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1) ON k = n_nationkey""",
    "calc_revenue": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem",
    "calc_path": """SELECT o_orderkey, n_name AS nation_name, upper(r_name) AS region_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "calc_udf": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size > 40 THEN 'large' ELSE 'middle' END AS size_class FROM part",
    "calc_series": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size > 40 THEN 'large' ELSE 'middle' END AS size_class FROM part",
    "link_customer": "SELECT o_orderkey, coalesce(c_custkey, -1) AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "link_missing": "SELECT o_orderkey, coalesce(c_custkey, -1) AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "link_first_duplicate": "SELECT c_custkey, coalesce(m, -1) AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "link_nullsafe": """WITH s AS (SELECT nullif(s_suppkey % 7, 5) AS k, min(s_suppkey) AS m FROM supplier GROUP BY 1)
        SELECT p_partkey, coalesce(m, -1) AS supplier FROM part LEFT JOIN s ON nullif(CAST(p_size AS BIGINT) % 7, 3) IS NOT DISTINCT FROM s.k""",
    "link_two_keys": """WITH s AS (SELECT s_nationkey, floor(s_acctbal / 1000) AS band, min(s_suppkey) AS m FROM supplier GROUP BY 1, 2)
        SELECT c_custkey, coalesce(m, -1) AS peer FROM customer LEFT JOIN s ON c_nationkey = s_nationkey AND floor(c_acctbal / 1000) = s.band""",
    "link_range_number": "SELECT p_partkey, CASE WHEN p_retailprice >= 950 AND p_retailprice < 1750 THEN CAST(floor((p_retailprice - 950) / 100) AS BIGINT) ELSE -1 END AS band FROM part",
    "link_range_duration": """SELECT event_id, CASE WHEN d >= 0 AND d < 40 THEN d ELSE -1 END AS part FROM (SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 07:00:00')) / 21600000000) AS BIGINT) AS d FROM events)""",
    "link_range_period": """SELECT o_orderkey, CASE WHEN m >= 0 AND m < 40 THEN m ELSE -1 END AS month FROM (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - (1993 * 12 + 3) AS BIGINT) AS m FROM orders)""",
    "project_distinct": "SELECT row_number() OVER (ORDER BY min(p_partkey)) - 1 AS brand_id, p_brand AS name, count(*) AS n_parts FROM part GROUP BY p_brand",
    "project_where": """WITH k AS (SELECT p_brand, p_size, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part WHERE p_size > 40 AND p_brand <> 'Brand#11' GROUP BY 1, 2)
        SELECT p_partkey, coalesce(id, -1) AS of_kind FROM part LEFT JOIN k USING (p_brand, p_size)""",
    "project_range_gaps": """WITH e AS (SELECT event_id, value, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-31')) / 20000000) AS BIGINT) AS q FROM events WHERE ts >= TIMESTAMP '2023-12-31'),
        f AS (SELECT q AS first FROM e WHERE q < 10000000 ORDER BY event_id LIMIT 1), r AS (SELECT unnest(generate_series((SELECT first FROM f), (SELECT least(max(q), 9999999) FROM e))) AS interval)
        SELECT interval - first AS stretch_id, interval, round(coalesce(sum(value), 0), 4) AS total FROM r CROSS JOIN f LEFT JOIN e ON q = interval GROUP BY first, interval""",
    "project_range_seconds": """WITH e AS (SELECT event_id, value, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-31')) / 1000000) AS BIGINT) AS q FROM events WHERE ts >= TIMESTAMP '2023-12-31'),
        f AS (SELECT q AS first FROM e WHERE q < 100000000 ORDER BY event_id LIMIT 1), r AS (SELECT unnest(generate_series((SELECT first FROM f), (SELECT least(max(q), 99999999) FROM e))) AS interval)
        SELECT interval - first AS second_id, interval, round(coalesce(sum(value), 0), 4) AS total FROM r CROSS JOIN f LEFT JOIN e ON q = interval GROUP BY first, interval""",
    "accumulate_customer": """SELECT c_custkey, round(coalesce(t, 0), 2) AS total, coalesce(k, 0) AS n, coalesce(m, -1) AS largest, round(CASE WHEN k > 0 THEN t / k ELSE 0 END, 4) AS mean
        FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t, count(*) AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "accumulate_path": f"""WITH t AS (SELECT n.n_nationkey AS k, sum(o_totalprice) AS v FROM {_SALES} GROUP BY 1), r AS (SELECT n_regionkey, sum(v) AS rv FROM t JOIN nation ON n_nationkey = k GROUP BY 1)
        SELECT n_name, round(coalesce(v, 0), 2) AS total, round(coalesce(v, 0) / rv, 6) AS share FROM nation LEFT JOIN t ON k = n_nationkey LEFT JOIN r USING (n_regionkey)""",
    "accumulate_of_accumulate": """WITH t AS (SELECT c_nationkey, c_acctbal, coalesce(v, 0) AS v FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey)
        SELECT n_name, round(coalesce(b, 0), 2) AS best, round(coalesce(w, 0), 4) AS weighted FROM nation LEFT JOIN (SELECT c_nationkey, max(v) AS b, sum(c_acctbal * v) / nullif(sum(v), 0) AS w FROM t GROUP BY 1) ON c_nationkey = n_nationkey""",
    "accumulate_retract": """SELECT c_custkey, round(coalesce(v, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) // 2 FROM orders) GROUP BY 1) ON o_custkey = c_custkey""",
    "accumulate_fold": """WITH f AS (SELECT user_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(value ORDER BY event_id)), lambda a, x: a * 0.5 + x), 4) AS level FROM events GROUP BY 1)
        SELECT user_id, level, level AS streamed FROM f""",
    "roll_rows": f"SELECT event_id, round(sum(value) {_FRAME.format(6, 0)}, 4) AS r FROM events",
    "roll_future": f"SELECT event_id, round(max(value) {_FRAME.format(2, 2)}, 4) AS r FROM events",
    "roll_weighted": f"SELECT event_id, round(value + {' + '.join(_LAG.format(k) + f' / {k + 1}' for k in range(1, 5))}, 4) AS r FROM events",
    "roll_smooth": f"SELECT event_id, round((value + {' + '.join(_LAG.format(k) + f' * exp(-{k})' for k in range(1, 4))}) / (1 + exp(-1) + exp(-2) + exp(-3)), 4) AS r FROM events",
    "roll_mean": f"SELECT event_id, round(sum(value / 10.0) {_FRAME.format(9, 0)}, 4) AS r FROM events",
    "roll_diff": f"SELECT event_id, round(value - {_LAG.format(1)}, 4) AS r FROM events",
    "roll_time": "SELECT event_id, round(sum(value) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 4) AS r FROM events",
    "product_all": "SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS pair_id, CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region CROSS JOIN nation",
    "product_where": """SELECT row_number() OVER (ORDER BY n_nationkey, s_suppkey) - 1 AS pair_id, CAST(n_nationkey AS BIGINT) AS n, s_suppkey AS s FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 5000""",
    "range_number": "SELECT range AS _id, 10.0::DOUBLE + range * 2.5::DOUBLE AS value FROM range(1000)",
    "range_duration": "SELECT range AS _id, epoch_us(TIMESTAMP '2024-01-01') + range * 1200000000 AS micros FROM range(500)",
    "range_period": "SELECT range AS _id, strftime(DATE '2018-01-10' + to_months(CAST(range AS INTEGER)), '%Y-%m-%d') AS day FROM range(60)",
    "vwap_hourly": _HOURS + """v AS (SELECT hour, sum(value * (user_id % 10 + 1)) / sum(user_id % 10 + 1) AS vwap, count(*) AS n FROM h GROUP BY 1)
        SELECT interval, round(coalesce(vwap, 0), 7) AS vwap, coalesce(n, 0) AS n FROM r LEFT JOIN v ON hour = interval""",
    "tumble_then_roll": _HOURS + """t AS (SELECT interval, coalesce(sum(value), 0) AS total FROM r LEFT JOIN h ON hour = interval GROUP BY 1)
        SELECT interval, round(total, 4) AS total, round(sum(total / 3.0) OVER (ORDER BY interval ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smooth FROM t""",
    "window_tumbling": """SELECT CAST(floor(epoch_us(ts) / 1800000000) * 1800000000 AS BIGINT) AS start_micros, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "window_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS brk FROM events),
        s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT epoch_us(min(ts)) AS start_micros, user_id, count(*) AS n, max(value) AS top FROM s GROUP BY user_id, sid""",
    "stream_totals": "SELECT event_type AS name, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "retention_count": "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 500",
    "retention_age": "SELECT event_id, value FROM events WHERE event_id >= coalesce((SELECT min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-05' - INTERVAL 36 HOUR), 9223372036854775807)",
    "formula_calc": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + l_quantity, 6) AS charge FROM lineitem",
    "formula_path": "SELECT o_orderkey, round(o_totalprice - c_acctbal, 4) AS gap FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "formula_fold": "SELECT c_custkey, round(1 + 2 * coalesce(v, 0), 2) AS twice FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "semi_anti": "SELECT o_custkey IS NOT NULL AS has_orders, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY 1",
}
