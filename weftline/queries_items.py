"""One query for every remaining item of the engine's surface, with its SQL."""

from __future__ import annotations

import csv
import datetime as dt
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import EngineError
from weftline.functions import formula as formulas
from weftline.functions.scalars import ordered_intersection
from weftline.model import Schema, Table
from weftline.operators.accumulate import Count, Sum
from weftline.operators.ids import ID
from weftline.operators.ranges import DurationRange
from weftline.queries_engine import EVENTS_FROM, tables
from weftline.session import read_table, scratch_folder
from weftline.sources import files
from weftline.sources.replay import file_stream, replay, tasks
from weftline.streaming import server as S
from weftline.streaming.state import sliding_totals


def _one(spark: SparkSession, sf_dir: str, name: str) -> tuple[Schema, Table]:
    s, t = tables(spark, sf_dir, name)
    return s, t[name]


def noop_table(spark, sf_dir):
    """A table that loses its definition keeps its rows."""
    s, t = _one(spark, sf_dir, "nation")
    t.noop()
    s.evaluate()
    return t.df().select("n_nationkey", "n_name")


def string_length(spark, sf_dir):
    s, t = _one(spark, sf_dir, "part")
    s.create_column("n", t, kind="int").calculate(lambda p: F.length(p[0]), "p_name")
    s.evaluate()
    return t.df().select("p_partkey", "n")


def add_after_one(spark, sf_dir):
    """A table of one row, to which all regions are added: ids go on from it."""
    region = read_table(spark, sf_dir, "region").select("r_name")
    s = Schema(spark)
    t = s.create_table("t").load(region.filter("r_name = 'ASIA'"))
    t.add(region.orderBy("r_name").coalesce(1))
    s.evaluate()
    return t.df().select(F.col(ID).alias("row_id"), "r_name")


def remove_one(spark, sf_dir):
    s, t = _one(spark, sf_dir, "customer")
    t.remove(1)
    s.evaluate()
    return t.df().select("c_custkey")


def remove_all(spark, sf_dir):
    s, t = _one(spark, sf_dir, "customer")
    first, last = t.remove()
    s.evaluate()
    return t.df().agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(last - first).cast("long").alias("removed"))


def reset_and_refill(spark, sf_dir):
    """Ids begin at 0 again."""
    s, t = _one(spark, sf_dir, "nation")
    t.reset()
    t.add([{"n_nationkey": 7, "n_name": "first"}, {"n_nationkey": 8, "n_name": "second"}])
    s.evaluate()
    return t.df().select(F.col(ID).alias("row_id"), "n_name")


def record_set(spark, sf_dir):
    """A record is read by its id and written back with other values."""
    s, t = _one(spark, sf_dir, "nation")
    got = t.row(3, ["n_name", "n_regionkey"])
    t.set_row(4, got)
    s.evaluate()
    return t.df().select("n_nationkey", "n_name", "n_regionkey")


def record_find(spark, sf_dir):
    s, t = _one(spark, sf_dir, "orders")
    top = t.data.agg(F.max("o_custkey")).first()[0]
    return spark.createDataFrame([(t.find({"o_custkey": top}), t.find({"o_custkey": -5}))], "found long, missing long")


def cell_values(spark, sf_dir):
    """Cells are set where a condition holds, and read one by one."""
    s, t = _one(spark, sf_dir, "nation")
    t.column("n_name").set_values("NOWHERE", F.col("n_regionkey") == 2)
    s.evaluate()
    return spark.createDataFrame([(k, t.column("n_name").value(k)) for k in range(25)], "n_nationkey int, n_name string")


def sorted_search(spark, sf_dir):
    s, t = _one(spark, sf_dir, "events")
    c = t.column("ts")
    return spark.createDataFrame([(c.lower_bound(EVENTS_FROM + dt.timedelta(days=10)), c.lower_bound(EVENTS_FROM + dt.timedelta(days=10_000)))], "reached long, beyond long")


def table_ranges(spark, sf_dir):
    s, t = _one(spark, sf_dir, "customer")
    s.evaluate()
    before = t.is_changed()
    t.add([{"c_custkey": -1}])
    t.remove(10)
    (a, b), (c, d) = t.changes()
    after = t.is_changed()
    s.evaluate()
    low, high = t.id_range()
    return spark.createDataFrame([(b - a, d - c, before, after, t.length(), high - low)], "added long, removed long, was_changed boolean, is_changed boolean, length long, span long")


def catalog(spark, sf_dir):
    s, t = _one(spark, sf_dir, "region")
    extra = s.create_table("extra")
    s.create_column("to_extra", t, extra)
    s.rename(s.create_column("x", t), "y")
    s.create_column("z", t)
    s.delete_column(t.column("z"))
    s.delete_table(extra)
    rows = [("table", x.name) for x in s.tables] + [("column", c.name) for c in t.columns() if not c.name.startswith("r_c")]
    return spark.createDataFrame(rows, "kind string, name string")


def lineage(spark, sf_dir):
    s, t = tables(spark, sf_dir, "orders", "customer")
    link = s.create_column("customer", t["orders"], t["customer"]).link("o_custkey", "c_custkey")
    c = s.create_column("balance", t["orders"]).calculate(lambda p: p[0], "customer.c_acctbal")
    return spark.createDataFrame([(str(e), c.has_dependency(e), e.has_dependent(c)) for e in (link, t["customer"], t["customer"].column("c_acctbal"), t["customer"].column("c_name"))], "element string, needed boolean, used boolean")


def cycles_refused(spark, sf_dir):
    s, t = _one(spark, sf_dir, "region")
    a = s.create_column("a", t).calculate("[r_regionkey] + 1")
    b = s.create_column("b", t).calculate("[a] * 2")
    try:
        a.calculate("[b] + 1")
        code = "none"
    except EngineError as e:
        code = e.code.name
    b.calculate("[r_regionkey] * 2")
    s.evaluate(b)
    return t.df().select("r_regionkey", "b", F.lit(code).alias("code"))


def array_intersection(spark, sf_dir):
    """Execution numbers of a notebook that it shares with 1 to 20, in order."""
    docs = read_table(spark, sf_dir, "documents")
    got = ordered_intersection(F.array_sort(F.array_distinct(F.filter("exec_order", lambda x: x.isNotNull()))), F.sequence(F.lit(1), F.lit(20)))
    return docs.select("doc_id", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("shared")).filter("shared is not null and shared <> ''")


def inserts(spark, sf_dir):
    s = Schema(spark)
    t = s.create_table("t")
    s.create_column("name", t, kind="string").set_default("none")
    s.create_column("v", t).set_default(1.5)
    t.add([{"name": "a", "v": 2.0}, {"name": "b"}, {}])
    t.add(read_table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("v")))
    s.evaluate()
    return t.df().select(F.col(ID).alias("row_id"), "name", "v")


def csv_round_trip(spark, sf_dir):
    """Parts are written with quotes and blanks around fields, and read again as strings."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", F.concat(F.lit('say "'), "p_brand", F.lit('", or not')).alias("quoted"))
    place = scratch_folder(spark, "csv")
    part.write.option("header", True).option("escape", '"').csv(place)
    return files.read_csv(spark, place)


def sink_round_trip(spark, sf_dir):
    place = scratch_folder(spark, "sink")
    files.write(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), place, "json", partition_by=["s_nationkey"])
    return files.read(spark, place, "json").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))


def replay_records(spark, sf_dir):
    """Regions arrive one after another, two of them together."""
    s = Schema(spark)
    t = s.create_table("t")
    s.create_column("at", t, kind="timestamp")
    s.create_column("name", t, kind="string")
    records = [(r[0],) for r in read_table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    server, sizes = S.Server(s), []
    replay(records, [0.0, 1.0, 0.0, 1.0, 1.0], lambda rows: sizes.append(len(rows)) or server.submit(S.add(t, [{"at": r[0].replace(tzinfo=None), "name": r[1]} for r in rows])), sleep=lambda _: None)
    s.evaluate()
    return t.df().select(F.col(ID).alias("row_id"), "name", F.lit(",".join(map(str, sizes))).alias("sizes"))


def replay_pauses(spark, sf_dir):
    """A file of nations with times, played faster: what comes together and after what pause."""
    names = [r[0] for r in read_table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]
    text = io.StringIO("t,name\n" + "\n".join(f"{k // 2 * 10},{n}" for k, n in enumerate(names)) + "\n")
    rows = list(csv.DictReader(text))
    at = [float(r["t"]) for r in rows]
    delays = [0.0, *((b - a) / 5 for a, b in zip(at, at[1:]))]
    got = [(k, pause, r[0]) for k, (pause, group) in enumerate(tasks([(r["name"],) for r in rows], delays)) for r in group]
    return spark.createDataFrame(got, "task long, pause double, name string")


class _Orders(S.Connector):
    """A connector of one's own: brings the regions, one per task."""

    def run(self) -> None:
        table, names = self.actions[0], self.actions[1]
        for n in names:
            if self.stopping.is_set():
                return
            self.server.put([S.add(table, [{"name": n}]), S.evaluate])


def connectors(spark, sf_dir):
    """A timer and an own connector feed one worker, which ends when all is done."""
    s = Schema(spark)
    t = s.create_table("t")
    s.create_column("name", t, kind="string")
    s.create_column("n", t, kind="int").calculate(lambda p: F.length(p[0]), "name")
    names = [r[0] for r in read_table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    server, ticks = S.Server(s), []
    own = _Orders(server, t, names)
    server.connectors = [S.Timer(server, 0.05, lambda ctx: ticks.append(ctx.server is server)), own]
    server.begin()
    own.thread.join(60)
    server.put(lambda ctx: None).wait(120)
    ended = server.stop()
    return t.df().select(F.col(ID).alias("row_id"), "name", "n", F.lit(ended and all(ticks) and bool(ticks)).alias("ended"))


def custom_action(spark, sf_dir):
    """An action that drops rows by a condition of its own."""
    s, t = _one(spark, sf_dir, "customer")
    S.Server(s).submit([lambda ctx: t.replace(t.data.filter(F.col("c_acctbal") > 0)), S.evaluate])
    return t.df().select("c_custkey")


def alerts(spark, sf_dir):
    """Large values among all events are told of, each once, however often the task runs."""
    s, t = _one(spark, sf_dir, "events")
    told: list[dict] = []
    server = S.Server(s)
    look = S.alert(t, F.col("value") > 99.9, told.extend, ["value"], most=1_000_000)
    for _ in range(2):
        server.submit([S.evaluate, look])
    return spark.createDataFrame([(r[ID], r["value"]) for r in told], "event_id long, value double")


def closed_hours(spark, sf_dir):
    """Hourly totals without the last hour, which may still grow."""
    s, t = _one(spark, sf_dir, "events")
    r = s.create_table("hours").range(DurationRange(EVENTS_FROM, dt.timedelta(hours=1), 1_000_000))
    s.create_column("hour", t, r).project("ts")
    s.create_column("n", r, kind="bigint").set_default(0).accumulate("hour", t, lambda p: Count())
    s.evaluate()
    return S.closed(r.df()).select("interval", "n")


def stream_sliding(spark, sf_dir):
    """A stream of all events: totals per user of the values of the last day before the user's latest event."""
    place = scratch_folder(spark, "sliding")
    events = read_table(spark, sf_dir, "events")
    stream = file_stream(spark, sf_dir, events.schema, "parquet", pathGlobFilter="events.parquet")
    kept: list[DataFrame] = []

    def keep(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/out/batch={k}")
        kept.append(df)

    totals = sliding_totals(stream, "user_id", "ts", "value", 86_400)
    totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{place}/out")
    last = got.groupBy("key").agg(F.max_by(F.struct("total", "n"), "batch").alias("x"))
    return last.select(F.col("key").cast("long").alias("user_id"), F.round("x.total", 4).alias("total"), "x.n")


def stream_incremental(spark, sf_dir):
    """Events arrive in four batches; totals per event type follow from what each batch adds and what retention removes."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    s = Schema(spark)
    kinds = s.create_table("kinds").load(events.select("event_type").distinct(), order_by=["event_type"])
    t = s.create_table("events")
    for name, kind in (("event_id", "bigint"), ("event_type", "string"), ("value", "double")):
        s.create_column(name, t, kind=kind)
    s.create_column("of_kind", t, kinds).link("event_type", "event_type")
    s.create_column("total", kinds).accumulate("of_kind", t, lambda p: Sum(p[0]), "value", incremental=True)
    s.create_column("n", kinds, kind="bigint").set_default(0).accumulate("of_kind", t, lambda p: Count(), incremental=True)
    server = S.Server(s, scratch_folder(spark, "batches"))
    n = events.count()
    for k in range(4):
        part = events.filter((F.col("event_id") >= n * k // 4) & (F.col("event_id") < n * (k + 1) // 4)).orderBy("event_id")
        server.run_batch([S.add(t), S.keep_last(t, n // 2), S.evaluate], part, k)
    return kinds.df().select("event_type", (F.round("total", 2) + 0.0).alias("total"), "n")


def formula_names(spark, sf_dir):
    """Names with blanks, paths with blanks around the dot, a single name of any type, nulls and texts as numbers."""
    s, t = tables(spark, sf_dir, "nation", "region")
    s.create_column("of region", t["nation"], t["region"]).link("n_regionkey", "r_regionkey")
    s.create_column("as text", t["nation"], kind="string").calculate(lambda p: F.when(p[0] % 5 == 0, F.lit("")).otherwise(p[0].cast("string")), "n_nationkey")
    s.create_column("same", t["nation"], kind="string").calculate("[of region] . [r_name]")
    s.create_column("twice", t["nation"]).calculate("2 * [as text]")
    s.evaluate()
    return t["nation"].df().select("n_nationkey", "same", F.nanvl("twice", F.lit(-1.0)).alias("twice"))


def formula_errors(spark, sf_dir):
    """Formulas that can't be read raise at once; those that can say what they refer to."""
    rows = []
    for text in ("[a] + ", "[a] + nope(1)", "2 * [a].[b] + sqrt([c])", "[a] $ 2", "[]", "[Out] + [x]"):
        try:
            f = formulas.parse(text)
            rows.append((text, "read", ";".join(".".join(p) for p in f.paths)))
        except EngineError as e:
            rows.append((text, e.code.name, ""))
    return spark.createDataFrame(rows, "formula string, result string, paths string")


def errors_kept(spark, sf_dir):
    """A column that fails keeps its error, what needs it is skipped, all else is evaluated."""
    s, t = _one(spark, sf_dir, "region")
    bad = s.create_column("bad", t).calculate(lambda p: 1 / 0, "r_regionkey")
    after = s.create_column("after", t).calculate("[bad] + 1")
    s.create_column("good", t).calculate("[r_regionkey] + 1")
    try:
        s.evaluate()
        code = "none"
    except EngineError as e:
        code = e.code.name
    return t.df().select("r_regionkey", "good", F.lit(code).alias("code"), F.lit(len(bad.errors)).cast("long").alias("n_errors"), F.lit("after" in t.df().columns or bool(after.errors)).alias("went_on"))


def _gapped(spark, sf_dir) -> tuple[Schema, Table]:
    """All orders, with ids that have gaps."""
    s = Schema(spark)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") * 10 + F.col("o_custkey") % 7).alias("place"))
    return s, s.create_table("orders").load(orders, id_column="place")


def roll_gaps(spark, sf_dir):
    """Rows count, not ids: a sum over five orders whose ids have gaps."""
    s, t = _gapped(spark, sf_dir)
    s.create_column("r", t).roll(5, 0, "o_totalprice", how=lambda p: F.sum(p[0]))
    s.evaluate()
    return t.df().select("o_orderkey", F.round("r", 2).alias("r"))


def retention_gaps(spark, sf_dir):
    s, t = _gapped(spark, sf_dir)
    S.Server(s).submit([S.keep_last(t, 700), S.evaluate])
    return t.df().select("o_orderkey")


def product_orders(spark, sf_dir):
    """Orders with the customers they belong to and that have a positive balance: no side is small, and the condition is the join."""
    s, t = tables(spark, sf_dir, "orders", "customer")
    p = s.create_table("pairs")
    s.create_column("o", p, t["orders"]).noop(True)
    s.create_column("c", p, t["customer"]).noop(True)
    p.product(lambda q: (q("o.o_custkey") == q("c.c_custkey")) & (q("c.c_acctbal") > 0))
    s.evaluate()
    return p.df().select(F.col(ID).alias("pair_id"), "o", "c")


QUERIES = {
    f.__name__: f
    for f in (
        noop_table, string_length, add_after_one, remove_one, remove_all, reset_and_refill, record_set, record_find, cell_values, sorted_search, table_ranges, catalog, lineage, cycles_refused, array_intersection,
        inserts, csv_round_trip, sink_round_trip, replay_records, replay_pauses, connectors, custom_action, alerts, closed_hours, stream_sliding, stream_incremental, formula_names, formula_errors, errors_kept,
        roll_gaps, retention_gaps, product_orders,
    )
}

SQL = {
    "noop_table": "SELECT n_nationkey, n_name FROM nation",
    "string_length": "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n FROM part",
    "add_after_one": "SELECT 0 AS row_id, 'ASIA' AS r_name UNION ALL SELECT row_number() OVER (ORDER BY r_name) AS row_id, r_name FROM region",
    "remove_one": "SELECT c_custkey FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)",
    "remove_all": "SELECT 0 AS n, max(c_custkey) + 1 - min(c_custkey) AS removed FROM customer",
    "reset_and_refill": "SELECT * FROM (VALUES (0, 'first'), (1, 'second')) v(row_id, n_name)",
    "record_set": "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE n_name END AS n_name, CASE WHEN n_nationkey = 4 THEN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) ELSE n_regionkey END AS n_regionkey FROM nation",
    "record_find": "SELECT (SELECT min(o_orderkey) FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)) AS found, -1 AS missing",
    "cell_values": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'NOWHERE' ELSE n_name END AS n_name FROM nation",
    "sorted_search": "SELECT coalesce((SELECT min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-11'), -1) AS reached, -1 AS beyond",
    "table_ranges": "SELECT 1 AS added, 10 AS removed, FALSE AS was_changed, TRUE AS is_changed, count(*) - 9 AS length, count(*) - 9 AS span FROM customer",
    "catalog": "SELECT * FROM (VALUES ('table', 'region'), ('column', 'r_regionkey'), ('column', 'r_name'), ('column', 'y')) v(kind, name)",
    "lineage": "SELECT * FROM (VALUES ('orders::customer', TRUE, TRUE), ('customer', TRUE, TRUE), ('customer::c_acctbal', TRUE, TRUE), ('customer::c_name', FALSE, FALSE)) v(element, needed, used)",
    "cycles_refused": "SELECT r_regionkey, CAST(r_regionkey * 2 AS DOUBLE) AS b, 'DEFINITION' AS code FROM region",
    "array_intersection": "SELECT doc_id, array_to_string(s, ',') AS shared FROM (SELECT doc_id, list_sort(list_filter(list_distinct(exec_order), lambda x: x BETWEEN 1 AND 20)) AS s FROM documents) WHERE len(s) > 0",
    "inserts": "SELECT * FROM (VALUES (0, 'a', 2.0), (1, 'b', 1.5), (2, 'none', 1.5)) v(row_id, name, v) UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey), r_name, CAST(r_regionkey AS DOUBLE) FROM region",
    "csv_round_trip": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, 'say \"' || p_brand || '\", or not' AS quoted FROM part",
    "sink_round_trip": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier",
    "replay_records": "SELECT row_number() OVER (ORDER BY r_name) - 1 AS row_id, r_name AS name, '1,2,1,1' AS sizes FROM region",
    "replay_pauses": "SELECT CAST(floor(k / 2) AS BIGINT) AS task, CAST(CASE WHEN k < 2 THEN 0 ELSE 2 END AS DOUBLE) AS pause, n_name AS name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)",
    "connectors": "SELECT row_number() OVER (ORDER BY r_name) - 1 AS row_id, r_name AS name, CAST(length(r_name) AS INTEGER) AS n, TRUE AS ended FROM region",
    "custom_action": "SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "alerts": "SELECT event_id, value FROM events WHERE value > 99.9",
    "closed_hours": """WITH h AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) - floor(epoch_us(TIMESTAMP '2024-01-01') / 3600000000) AS BIGINT) AS hour, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01'),
        r AS (SELECT unnest(generate_series((SELECT hour FROM h ORDER BY event_id LIMIT 1), (SELECT max(hour) - 1 FROM h))) AS interval)
        SELECT interval, count(event_id) AS n FROM r LEFT JOIN h ON hour = interval GROUP BY interval""",
    "stream_sliding": """SELECT e.user_id, round(sum(value), 4) AS total, count(*) AS n FROM events e JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) l ON l.user_id = e.user_id AND epoch_us(e.ts) > epoch_us(l.last) - 86400000000
        WHERE value IS NOT NULL GROUP BY 1""",
    "stream_incremental": """WITH e AS (SELECT * FROM events ORDER BY event_id DESC LIMIT (SELECT count(*) // 2 FROM events))
        SELECT k.event_type, round(coalesce(sum(value), 0), 2) AS total, count(value) AS n FROM (SELECT DISTINCT event_type FROM events) k LEFT JOIN e USING (event_type) GROUP BY 1""",
    "formula_names": "SELECT n_nationkey, r_name AS same, CAST(CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE 2 * n_nationkey END AS DOUBLE) AS twice FROM nation JOIN region ON r_regionkey = n_regionkey",
    "formula_errors": """SELECT * FROM (VALUES ('[a] + ', 'DEFINITION', ''), ('[a] + nope(1)', 'DEFINITION', ''), ('2 * [a].[b] + sqrt([c])', 'read', 'a.b;c'), ('[a] $ 2', 'DEFINITION', ''), ('[]', 'DEFINITION', ''), ('[Out] + [x]', 'read', 'Out;x')) v(formula, result, paths)""",
    "errors_kept": "SELECT r_regionkey, CAST(r_regionkey + 1 AS DOUBLE) AS good, 'DEFINITION' AS code, 1 AS n_errors, FALSE AS went_on FROM region",
    "roll_gaps": "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS r FROM orders",
    "retention_gaps": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 700",
    "product_orders": "SELECT row_number() OVER (ORDER BY o_orderkey, c_custkey) - 1 AS pair_id, o_orderkey AS o, c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
}
