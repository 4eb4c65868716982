"""Sources that replay records as if they arrived now."""

from __future__ import annotations

import csv
import datetime as dt
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def tasks(records: list[tuple], delays: list[float] | float) -> Iterator[tuple[float, list[tuple]]]:
    """``(pause in seconds, records)``: records without a pause before them come together with the one before."""
    group: list[tuple] = []
    pause = 0.0
    for i, r in enumerate(records):
        wait = delays[i] if isinstance(delays, list) else delays
        if group and wait > 0:
            yield pause, group
            group, pause = [], 0.0
        pause += wait if not group else 0.0
        group.append(r)
    if group:
        yield pause, group


def replay(records: list[tuple], delays: list[float] | float, submit: Callable[[list[tuple]], None], clock: Callable[[], dt.datetime] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Submit the records of each task after its pause, with the time of submission as a first value; gives the number of tasks."""
    now = clock or (lambda: dt.datetime.now(dt.timezone.utc))
    n = 0
    for pause, group in tasks(records, delays):
        if pause:
            sleep(pause)
        submit([(now(), *r) for r in group])
        n += 1
    return n


def replay_csv(path: str, time_column: str, parse_time: Callable[[str], float], accelerate: float, submit: Callable[[list[tuple]], None], clock: Callable[[], dt.datetime] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Replay a file with a header: ``parse_time`` gives seconds, whose differences, divided by ``accelerate``, are the pauses."""
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    names = [k for k in (rows[0] if rows else {}) if k != time_column]
    at = [parse_time(r[time_column]) for r in rows]
    delays = [0.0, *(max(0.0, (b - a) / accelerate) for a, b in zip(at, at[1:]))] if rows else []
    return replay([tuple(r[k].strip() for k in names) for r in rows], delays, submit, clock, sleep)


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "csv", files_per_batch: int = 1, **options) -> DataFrame:
    """A stream of the files that appear in a folder, some at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        reader = reader.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(kind).load(folder)


def timer_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Ticks; how often they are acted on is the trigger of the query that reads them."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
