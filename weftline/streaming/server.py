"""Streams: appended rows, re-evaluated definitions, retention.

Each micro-batch is a task: its rows are appended to a table, the attached
actions run in order, and what the batch added is written down under its number.
A batch that is run again after a failure starts from the tables as the batch
before left them, so it has its effect once.  Tasks of other kinds (timers, own
connectors) wait in a queue for the one worker that runs all of them in turn.
"""

from __future__ import annotations

import datetime as dt
import json
import queue
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weftline.errors import EngineError, ErrorCode
from weftline.model import Schema, Table
from weftline.operators.ids import ID
from weftline.session import delete_scratch, scratch_made

Clock = Callable[[], dt.datetime]
#: A table that has been written in so many parts is written as one.
MOST_PARTS = 64


def wall_clock() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass
class Context:
    """What an action sees: the server, its schema, and the rows of the batch."""

    server: Server
    schema: Schema
    batch: DataFrame | None = None
    batch_id: int = -1


Action = Callable[[Context], None]


def add(table: Table, rows: list[dict] | None = None) -> Action:
    """Append rows, or those of the batch."""
    return lambda ctx: table.add(rows if rows is not None else ctx.batch) and None


def evaluate(ctx: Context) -> None:
    ctx.schema.evaluate()


def keep_last(table: Table, size: int) -> Action:
    """Keep the newest ``size`` rows; 0 empties the table."""

    def run(ctx: Context) -> None:
        n = table.data.filter(F.col(ID) >= table.low).count()
        if n > size:
            table.remove(n - size)

    return run


def drop_older(table: Table, column: str, age: dt.timedelta, clock: Clock = wall_clock) -> Action:
    """Remove the leading rows whose time is before now less ``age``."""
    return lambda ctx: table.remove_below(column, clock() - age) and None


def alert(table: Table, condition: str | Column, tell: Callable[[list[dict]], None], columns: list[str] | None = None, key: str = ID, most: int = 1000) -> Action:
    """Tell of the rows of a table that hold a condition, each (by ``key``) once; at most ``most`` of them per task, the rest with the next."""
    last: list[Any] = []

    def run(ctx: Context) -> None:
        df = table.df().filter(condition)
        df = df.filter(F.col(key) > F.lit(last[0])) if last else df
        rows = df.select(key, *(f"`{c}`" for c in (columns or [c for c in df.columns if c != key]) if c != key)).orderBy(key).limit(most).collect()
        if rows:
            last[:] = [rows[-1][0]]
            tell([r.asDict() for r in rows])

    return run


def closed(intervals: DataFrame, number: str = "interval") -> DataFrame:
    """Intervals without the last one, which rows may still come to."""
    last = intervals.agg(F.max(number).alias("n")).scalar()
    return intervals.filter(F.col(number) < last)


@dataclass
class Task:
    """Actions to be run in order, and the rows they are about; ``wait`` blocks until that has happened."""

    actions: list[Action]
    batch: DataFrame | None = None
    batch_id: int = -1
    ok: bool | None = None
    over: threading.Event = field(default_factory=threading.Event)

    def wait(self, seconds: float | None = None) -> bool | None:
        """Whether the task ended without an error; None if it hasn't ended yet."""
        self.over.wait(seconds)
        return self.ok


class Connector:
    """Something that submits tasks by itself between ``start`` and ``stop``; override ``run``, which should return soon after ``self.stopping`` is set."""

    def __init__(self, server: Server, *actions: Action):
        self.server, self.actions, self.stopping = server, list(actions), threading.Event()
        self.thread: threading.Thread | None = None

    def run(self) -> None:
        raise NotImplementedError

    def start(self) -> None:
        self.stopping.clear()
        self.thread = threading.Thread(target=self.run, daemon=True)
        self.thread.start()

    def stop(self, seconds: float = 5.0) -> None:
        self.stopping.set()
        if self.thread is not None:
            self.thread.join(seconds)


class Timer(Connector):
    """Submits its actions every ``period`` seconds, first after one period."""

    def __init__(self, server: Server, period: float, *actions: Action):
        super().__init__(server, *actions)
        self.period = period

    def run(self) -> None:
        while not self.stopping.wait(self.period):
            self.server.put(self.actions)


class Simulator(Connector):
    """Replays records into a table as if they arrived now; the actions run after each task's records have been added."""

    def __init__(self, server: Server, table: Table, columns: list[str], records: list[tuple], delays: list[float] | float, *actions: Action):
        super().__init__(server, *actions)
        self.table, self.columns, self.records, self.delays = table, columns, records, delays

    def run(self) -> None:
        from weftline.sources.replay import tasks

        for pause, group in tasks(self.records, self.delays):
            if self.stopping.wait(pause):
                return
            now = wall_clock()
            self.server.put([add(self.table, [dict(zip(self.columns, (now, *r))) for r in group]), *self.actions])


@dataclass
class Server:
    """Runs tasks one after another on a schema; ``folder`` (shared by the cluster) holds the tables between batches.

    ``submit`` runs a task at once.  After ``begin``, tasks that are ``put`` wait in
    a queue of bounded length for a worker; ``stop`` ends the connectors, lets the
    worker finish what is waiting, and ends it.
    """

    schema: Schema
    folder: str | None = None
    errors: list[Exception] = field(default_factory=list)
    done: int = -1
    capacity: int = 1000
    connectors: list[Connector] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._turn = threading.RLock()  # one task at a time, whoever brings it
        self._waiting: queue.Queue = queue.Queue(self.capacity)
        self._worker: threading.Thread | None = None
        self._parts: dict[str, dict] = {}
        self._scratch: list[str] = []

    def begin(self) -> None:
        """Start the worker and the connectors."""
        if self._worker is None:

            def work() -> None:
                while (task := self._waiting.get()) is not None:
                    task.ok = self.submit(task.actions, task.batch, task.batch_id)
                    task.over.set()

            self._worker = threading.Thread(target=work, daemon=True)
            self._worker.start()
        for c in self.connectors:
            c.start()

    def put(self, actions: Action | Iterable[Action], batch: DataFrame | None = None) -> Task:
        """Queue a task for the worker; waits while the queue is full."""
        task = Task([actions] if callable(actions) else list(actions), batch)
        self._waiting.put(task)
        return task

    def stop(self, seconds: float = 60.0) -> bool:
        """End connectors and worker; whether the worker got through all that was waiting in time."""
        for c in self.connectors:
            c.stop()
        worker, self._worker = self._worker, None
        if worker is None:
            return True
        self._waiting.put(None)
        worker.join(seconds)
        return not worker.is_alive()

    def submit(self, actions: Action | Iterable[Action], batch: DataFrame | None = None, batch_id: int = -1) -> bool:
        """Run the actions in order; an error ends the task, is kept, and makes the result False."""
        ctx = Context(self, self.schema, batch, batch_id)
        with self._turn:
            try:
                for a in [actions] if callable(actions) else actions:
                    a(ctx)
                return True
            except Exception as e:  # noqa: BLE001
                self.errors.append(e)
                return False

    # tables between batches

    def _save(self, batch_id: int) -> None:
        """Write the rows the batch added; all rows of a table only if they changed otherwise. Parts that retention has emptied are deleted."""
        if self.folder is None:
            return
        state = {}
        for t in self.schema.tables:
            if t.data is None or t.is_derived:
                continue
            before = self._parts.get(t.name, {"parts": [], "next": 0, "rewrites": None})
            place, top = f"{self.folder}/{t.name}/batch={batch_id}", t._next()
            parts = [p for p in before["parts"] if p["top"] > t.low]
            if before["rewrites"] != t.rewrites or not 0 < len(parts) < MOST_PARTS:
                t.data.write.mode("overwrite").parquet(place)
                parts = [{"place": place, "top": top}]
            elif top > before["next"]:
                t.data.filter(F.col(ID) >= max(before["next"], t.low)).write.mode("overwrite").parquet(place)
                parts.append({"place": place, "top": top})
            state[t.name] = {"parts": parts, "low": t.low, "next": top, "schema": t.data.schema.json()}
        self.schema.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_state/batch={batch_id}")
        self._load(batch_id, state)

    def _clean(self) -> None:
        """Delete the states before the last two, and the parts that only they name."""
        known = self._saved()
        keep = {p["place"] for n in known[-2:] for s in self._state(n).values() for p in s["parts"]}
        for n in known[:-2]:
            old = {p["place"] for s in self._state(n).values() for p in s["parts"]}
            for place in (*(old - keep), f"{self.folder}/_state/batch={n}"):
                fs, path = self._fs(place)
                fs.delete(path, True)

    def _state(self, batch_id: int) -> dict:
        return json.loads(self.schema.spark.read.text(f"{self.folder}/_state/batch={batch_id}").first()[0])

    def _load(self, batch_id: int, state: dict | None = None) -> None:
        """Take the tables as a batch left them; the plans are short again."""
        own = state is not None
        for name, s in (state or self._state(batch_id)).items():
            t = self.schema.table(name)
            kept = self.schema.spark.read.schema(T.StructType.fromJson(json.loads(s["schema"]))).parquet(*(p["place"] for p in s["parts"])).filter(F.col(ID) >= s["low"])
            if own:
                t._change(kept)
            else:
                t.replace(kept)
                self.schema.states.clear()
            t.low, t.next_id = s["low"], s["next"]
            self._parts[name] = {"parts": s["parts"], "next": s["next"], "rewrites": t.rewrites}
        self.done = batch_id

    def _fs(self, place: str) -> tuple:
        path = self.schema.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.schema.spark._jsc.hadoopConfiguration()), path

    def _saved(self) -> list[int]:
        fs, path = self._fs(f"{self.folder}/_state")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "batch=" in s.getPath().getName())

    def run_batch(self, actions: list[Action], batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; to be handed to ``foreachBatch``.

        What it wrote for its own use is deleted after the next one that evaluates
        the schema; until then removed rows and states may still be read from it.
        """
        with self._turn:
            mark, evaluated = len(scratch_made), self.schema.evaluated_at
            if self.folder is not None:
                before = [b for b in self._saved() if b < batch_id]
                if before and self.done != before[-1]:
                    self._load(before[-1])
            if not self.submit(actions, batch, batch_id):
                raise EngineError(ErrorCode.ACTION, f"batch {batch_id} failed", str(self.errors[-1])) from self.errors[-1]
            self._save(batch_id)
            if self.folder is not None and self.schema.evaluated_at == evaluated:
                self._scratch += scratch_made[mark:]
            elif self.folder is not None:
                self._clean()
                old, self._scratch = self._scratch, scratch_made[mark:]
                delete_scratch(self.schema.spark, old)

    def start(self, stream: DataFrame, actions: list[Action], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
        """Feed a stream through the actions; ``trigger`` as for ``writeStream.trigger`` (available rows at once without one)."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.run_batch(actions, df, i)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
