import datetime as dt
import os

from pyspark.sql import functions as F

from weftline.model import Schema
from weftline.operators.accumulate import Sum
from weftline.sources.files import read, read_csv, write
from weftline.sources.replay import file_stream, replay, replay_csv, tasks
from weftline.streaming import server as S
from weftline.streaming.windows import filled, sessions, tumbling


def live(t, col):
    return [r[0] for r in t.df().orderBy("_id").select(col).collect()]


def test_age_and_count_retention(spark):
    s, now = Schema(spark), dt.datetime(2018, 1, 1, 12)
    t = s.create_table("T")
    s.create_column("A", t)
    s.create_column("B", t, kind="timestamp")
    t.add([{"A": float(i), "B": now - dt.timedelta(seconds=x)} for i, x in enumerate((180, 120, 60, 0))])
    server = S.Server(s)
    for action, want in ((S.keep_last(t, 10), 4), (S.drop_older(t, "B", dt.timedelta(hours=1), lambda: now), 4), (S.drop_older(t, "B", dt.timedelta(minutes=2), lambda: now), 3), (S.keep_last(t, 2), 2), (S.keep_last(t, 0), 0)):
        assert server.submit([action, S.evaluate]) and t.length() == want
    assert not server.submit(lambda ctx: 1 / 0) and isinstance(server.errors[0], ZeroDivisionError)


def test_batches_evaluate_and_trim(spark, tmp_path):
    for k, rows in enumerate([[(1, 2)], [(3, 4), (5, 6)], [(7, 8)]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text("A,B\n" + "\n".join(f"{a},{b}" for a, b in rows) + "\n")
        os.utime(tmp_path / "in" / f"{k}.csv", (1_700_000_000 + 60 * k,) * 2)  # files come in order of their times
    s = Schema(spark)
    t = s.create_table("T")
    s.create_column("A", t)
    s.create_column("B", t)
    s.create_column("C", t).calculate("[A] + [B]")
    seen = []
    server = S.Server(s, str(tmp_path / "state"))
    actions = [S.add(t), S.evaluate, lambda ctx: seen.append(live(t, "C")), S.keep_last(t, 3)]
    stream = file_stream(spark, str(tmp_path / "in"), "A double, B double")
    server.start(stream, actions, str(tmp_path / "check")).awaitTermination(120)
    assert seen == [[3], [3, 7, 11], [3, 7, 11, 15]] and server.done == 2
    s.evaluate()
    assert live(t, "C") == [7, 11, 15]
    # a new server goes on from what is written, and a batch that is run again has its effect once
    s2 = Schema(spark)
    t2 = s2.create_table("T")
    s2.create_column("A", t2)
    s2.create_column("B", t2)
    again = S.Server(s2, str(tmp_path / "state"))
    again.run_batch([S.add(t2), S.evaluate], spark.createDataFrame([(9.0, 9.0)], "A double, B double"), 2)
    assert live(t2, "A") == [1, 3, 5, 9]


def test_sliding_total_through_a_path(spark):
    s = Schema(spark)
    regions, users, clicks = (s.create_table(n) for n in ("REGIONS", "USERS", "CLICKS"))
    regions.load(spark.createDataFrame([(0, "Americas"), (1, "Europas")], "k int, Name string"), id_column="k")
    users.load(spark.createDataFrame([(0, "Alice", "Americas"), (1, "Max", "Europas")], "k int, Name string, Region string"), id_column="k")
    for name, kind in (("User", "string"), ("Count", "double")):
        s.create_column(name, clicks, kind=kind)
    s.create_column("U", clicks, users).link("User", "Name")
    s.create_column("R", users, regions).link("Region", "Name")
    s.create_column("Clicks", regions).accumulate("U.R", clicks, lambda p: Sum(p[0]), "Count")
    server = S.Server(s)
    totals = []
    for user, n in (("Alice", 1.0), ("Max", 2.0), ("Alice", 4.0), ("Nobody", 8.0)):
        assert server.submit([S.add(clicks, [{"User": user, "Count": n}]), S.keep_last(clicks, 2), S.evaluate]), server.errors
        totals.append(live(regions, "Clicks"))
    assert totals == [[1, 0], [1, 2], [4, 2], [4, 0]]


def test_replay(tmp_path):
    assert list(tasks([(1,), (3,), (5,), (7,)], [0.1, 0, 0.1, 0.2])) == [(0.1, [(1,), (3,)]), (0.1, [(5,)]), (0.2, [(7,)])]
    got, slept = [], []
    assert replay([(1,), (2,)], 0.5, got.append, lambda: "now", slept.append) == 2
    assert got == [[("now", 1)], [("now", 2)]] and slept == [0.5, 0.5]
    (tmp_path / "r.csv").write_text("Time,A\n10,1\n10,2\n30,3\n")
    got, slept = [], []
    assert replay_csv(str(tmp_path / "r.csv"), "Time", float, 10.0, got.append, lambda: 0, slept.append) == 2
    assert got == [[(0, "1"), (0, "2")], [(0, "3")]] and slept == [2.0]


def test_csv_with_quotes(spark, tmp_path):
    (tmp_path / "c.csv").write_text('CategoryID,Name\n 1 ,"a, ""b""\nc"\n')
    df = read_csv(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", 'a, "b"\nc')]
    write(df, str(tmp_path / "p"))
    assert read(spark, str(tmp_path / "p")).count() == 1 and read(spark, str(tmp_path / "c.csv"), "csv").count() == 1


def test_windows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), float(m)) for m in (1, 4, 16, 17)]
    df = spark.createDataFrame(rows, "ts timestamp, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = tumbling(df, "ts", "5 minutes", F.sum("v").alias("total"), F.count("*").alias("n"))
    assert sorted((r.start.minute, r.total, r.n) for r in got.collect()) == [(0, 5.0, 2), (15, 33.0, 2)]
    full = filled(got, start, dt.timedelta(minutes=5), 4, {"total": 0.0, "n": 0})
    assert [(r.interval, r.total, r.n) for r in full.orderBy("interval").collect()] == [(0, 5.0, 2), (1, 0.0, 0), (2, 0.0, 0), (3, 33.0, 2)]
    assert sorted(r.n for r in sessions(df, "ts", "10 minutes", [], F.count("*").alias("n")).collect()) == [2, 2]


def test_sliding_totals_forget_what_is_old(spark, tmp_path):
    from weftline.streaming.state import sliding_totals

    folder, start = tmp_path / "in", dt.datetime(2024, 1, 1)
    folder.mkdir()
    batches = [[("a", 0, 1.0), ("b", 5, 2.0)], [("a", 50, 4.0), ("a", 20, 8.0)], [("a", 65, 16.0), ("b", 5, 32.0), ("", 70, 1.0)]]
    for k, rows in enumerate(batches):
        lines = [f"{u},{(start + dt.timedelta(seconds=s)).isoformat()},{v}" for u, s, v in rows]
        (folder / f"{k}.csv").write_text("u,ts,v\n" + "\n".join(lines) + "\n")
        os.utime(folder / f"{k}.csv", (1_700_000_000 + 60 * k,) * 2)
    stream = file_stream(spark, str(folder), "u string, ts timestamp, v double")
    out = []

    def keep(df, i):
        out.append({r.key: (r.total, r.n) for r in df.collect()})

    q = sliding_totals(stream, "u", "ts", "v", 60, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [b for b in out if b] == [{"a": (1.0, 1), "b": (2.0, 1)}, {"a": (13.0, 3)}, {"a": (28.0, 3), "b": (34.0, 2)}]


def test_queue_timer_and_stop(spark):
    s = Schema(spark)
    t = s.create_table("T")
    s.create_column("at", t, kind="timestamp")
    s.create_column("A", t)
    server = S.Server(s)
    ticks, told = [], []
    server.connectors = [S.Timer(server, 0.2, lambda ctx: ticks.append(1)), S.Simulator(server, t, ["at", "A"], [(1.0,), (2.0,), (30.0,)], [0.0, 0.1, 0.0], S.evaluate, S.alert(t, "A > 1.5", told.append, ["A"]))]
    server.begin()
    assert server.put(lambda ctx: 1 / 0).wait(60) is False
    server.connectors[1].thread.join(60)
    assert server.put(S.evaluate).wait(120)
    assert server.put(S.alert(t, F.col("A") >= 30, told.append, ["A"])).wait(60)
    assert server.stop() and ticks and not server.connectors[0].thread.is_alive()
    n = len(ticks)
    assert [type(e) for e in server.errors] == [ZeroDivisionError] and live(t, "A") == [1.0, 2.0, 30.0]
    assert [[r["A"] for r in x] for x in told] == [[2.0, 30.0], [30.0]] and len(ticks) == n
    assert server.stop()  # again is no harm


def test_batches_write_what_they_add(spark, tmp_path):
    s = Schema(spark)
    t, kinds = s.create_table("T"), s.create_table("K").load(spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string"), id_column="k")
    s.create_column("kind", t, kind="string")
    s.create_column("v", t)
    s.create_column("to", t, kinds).link("kind", "name")
    s.create_column("total", kinds).accumulate("to", t, lambda p: Sum(p[0]), "v", incremental=True)
    server = S.Server(s, str(tmp_path))
    rows = lambda i: spark.createDataFrame([("ab"[j % 2], float(10 * i + j)) for j in range(3)], "kind string, v double")
    for i in range(5):
        server.run_batch([S.add(t), S.evaluate, S.keep_last(t, 6)], rows(i), i)
        parts = [p for p in (tmp_path / "T").iterdir()]
        assert len(parts) <= 4 and spark.read.parquet(str(tmp_path / "T" / f"batch={i}")).count() == 3  # only what came
    s.evaluate()
    assert live(t, "v") == [30.0, 31.0, 32.0, 40.0, 41.0, 42.0] and [r[0] for r in kinds.df().orderBy("_id").select("total").collect()] == [30 + 32 + 40 + 42.0, 31 + 41.0]
    assert len(list((tmp_path / "_state").iterdir())) == 2
    # after a failure the batch is run again from what is written
    server.run_batch([S.add(t), S.evaluate], rows(9), 4)
    assert live(t, "v")[-3:] == [90.0, 91.0, 92.0]
    # batches that evaluate nothing leave what a later evaluation reads
    for i in (5, 6, 7):
        server.run_batch([S.add(t), S.keep_last(t, 6)], rows(i), i)
    s.evaluate()
    assert live(t, "v") == [60.0, 61.0, 62.0, 70.0, 71.0, 72.0] and [r[0] for r in kinds.df().orderBy("_id").select("total").collect()] == [60 + 62 + 70 + 72.0, 61 + 71.0]


def test_the_last_interval_is_left_open(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "interval long, total double")
    assert sorted(r.interval for r in S.closed(df).collect()) == [0, 1, 2, 3] and S.closed(df.limit(0)).count() == 0
