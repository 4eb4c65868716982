import datetime as dt
import random

import duckdb

import __spark_entry__ as entry


def test_range_gaps_over_all_events(spark, tmp_path):
    """Every event from the first second on counts, and seconds without events are filled."""
    rnd, start = random.Random(4), dt.datetime(2024, 1, 1, 0, 0, 10)
    rows = [(k, start + dt.timedelta(seconds=3 * k, microseconds=rnd.randrange(10**6)), float(k)) for k in range(200)]
    rows[7] = (7, start - dt.timedelta(seconds=5), 1000.0)  # before the first event's second: late
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.interval: (r.second_id, r.total) for r in entry.queries()["project_range_seconds"](spark, str(tmp_path)).collect()}
    assert sum(t for _, t in got.values()) == sum(range(200)) - 7
    assert len(got) == 3 * 199 + 1 and sum(t == 0 for _, t in got.values()) == len(got) - 198  # event 0 adds 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == {i: (n, t) for n, i, t in con.execute(entry.oracle_sql()["project_range_seconds"]).fetchall()}
