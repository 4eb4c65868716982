"""Schemas of tables and columns with definitions.

A table is a DataFrame with row ids; a column is data of its table or has a
definition over other columns, reached by paths through links.  Definitions
only describe; ``Schema.evaluate`` turns them into lazy DataFrames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.functions import formula as formulas
from weftline.operators.ids import ID, arrival_ids, arrival_order, nth_id, with_ids
from weftline.operators.ranges import Range
from weftline.session import ship_package

if TYPE_CHECKING:
    from weftline.operators.accumulate import Aggregate

OBJECT = "Object"
Path = "str | Sequence[str] | Column"


def as_path(p: Any) -> tuple[str, ...]:
    """"a.b", ("a", "b") or a Column as a path of names."""
    if isinstance(p, Column):
        return (p.name,)
    return tuple(p.split(".")) if isinstance(p, str) else tuple(x.name if isinstance(x, Column) else x for x in p)


class Definition:
    """What an element is computed from; ``kind`` names the operation."""

    def __init__(self, kind: str, **parts: Any):
        self.kind, self.parts = kind, parts

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None


class Element:
    """What tables and columns share: identity, definition, errors, lineage."""

    schema: Schema
    name: str

    def __init__(self) -> None:
        self.id = uuid.uuid4()
        self.definition: Definition | None = None
        self.version = 0
        self.errors: list[Exception] = []

    def dependencies(self) -> list[Element]:
        raise NotImplementedError

    def dependents(self) -> list[Element]:
        return [e for e in self.schema.elements() if self in e.dependencies()]

    def has_dependency(self, other: Element, seen: set | None = None) -> bool:
        """Whether ``other`` is reached through dependencies."""
        seen = set() if seen is None else seen
        for d in self.dependencies():
            if d is other:
                return True
            if d.id not in seen:
                seen.add(d.id)
                if d.has_dependency(other, seen):
                    return True
        return False

    def has_dependent(self, other: Element) -> bool:
        return other.has_dependency(self)

    def define(self, definition: Definition | None) -> None:
        """Set the definition; a cycle is refused and the element left without one."""
        self.definition = definition
        self.version = self.schema.tick()
        try:
            cyclic = self.has_dependency(self)
        except EngineError:
            self.definition = None
            raise
        if cyclic:
            self.definition = None
            raise EngineError(ErrorCode.DEFINITION, f"{self} would depend on itself")

    @property
    def is_derived(self) -> bool:
        return self.definition is not None


class Column(Element):
    """A function from the rows of a table to values, or to rows of another table (a link)."""

    def __init__(self, schema: Schema, name: str, table: Table, output: Table | None, kind: str):
        super().__init__()
        self.schema, self.name, self.table, self.output, self.kind = schema, name, table, output, kind
        self.default: Any = None
        self.is_key = False

    def __repr__(self) -> str:
        return f"{self.table.name}::{self.name}"

    def set_default(self, value: Any) -> Column:
        self.default, self.version = value, self.schema.tick()
        return self

    # definitions

    def noop(self, is_key: bool = False) -> Column:
        """No definition: data set by the user, or a key filled by its table."""
        self.is_key = is_key
        self.define(None)
        return self

    def calculate(self, fn: Callable | str | None, *paths: Path, udf: bool | str = False) -> Column:
        """``fn`` gets a list of Columns and returns one; with ``udf="series"`` it gets pandas Series and returns one (a batch at a time), with ``udf=True`` it is plain Python over the values of a row; a string is a formula; None gives the default."""
        if isinstance(fn, str):
            f = formulas.parse(fn)
            self.define(Definition("calculate", fn=f, paths=list(f.paths), udf=False))
        else:
            self.define(Definition("calculate", fn=fn, paths=[as_path(p) for p in paths], udf=udf))
        return self

    def link(self, values: Path | Sequence[Path], *keys: Path) -> Column:
        """The row of the output table with equal keys; with one value and no keys, its interval in a range table."""
        target = self._target()
        if not keys:
            if target.range_definition() is None:
                raise EngineError(ErrorCode.DEFINITION, f"{target} is no range table: name the keys to link to")
            self.define(Definition("link_range", paths=[as_path(values)], grow=False))
        else:
            values = [values] if isinstance(values, (str, Column)) else list(values)
            self.define(Definition("link", paths=[as_path(v) for v in values], keys=[as_path(k)[0] for k in keys]))
        return self

    def project(self, values: Path | Sequence[Path], *keys: Path) -> Column:
        """As ``link``, but what isn't found is added to the output table."""
        target = self._target()
        if target.range_definition() is not None:
            self.define(Definition("link_range", paths=[as_path(values)], grow=True))
            return self
        names = [as_path(k)[0] for k in keys] or [k.name for k in target.key_columns()]
        if target.definition is None or target.definition.kind != "product":
            raise EngineError(ErrorCode.DEFINITION, f"{target} has no definition that rows can be added to")
        if not names or any(not target.column(n).is_key for n in names):
            raise EngineError(ErrorCode.DEFINITION, f"only key columns of {target} can be projected to")
        values = [values] if isinstance(values, (str, Column)) else list(values)
        self.define(Definition("project", paths=[as_path(v) for v in values], keys=names))
        return self

    def accumulate(self, group: Path, facts: Table, how: Callable[[list[SparkColumn]], Aggregate] | str, *paths: Path, remover: Callable[[list[SparkColumn]], Aggregate] | None = None, incremental: bool = False) -> Column:
        """``how`` gets the parameters of the facts as Columns and returns an aggregate; a formula with [out] is folded in order, as a sum where it only adds to [out].

        With ``incremental`` (or a ``remover``, which says what removed facts add;
        without one they are subtracted) sums and counts are brought up to date
        from the facts added and removed since the last evaluation.
        """
        if isinstance(how, str):
            f = formulas.parse(how)
            own = [p for p in f.paths if not (len(p) == 1 and p[0].lower() == "out")]
            from weftline.operators.accumulate import Fold, Sum

            step = f.increment()

            def fold(ps: list[SparkColumn]) -> Aggregate:
                if step is not None:
                    return Sum(step.column(lambda p: ps[own.index(p)]))
                return Fold(lambda acc, qs: f.column(lambda p: qs[own.index(p)], acc), tuple(ps))

            how, paths = fold, own
        self.define(Definition("accumulate", group=as_path(group), facts=facts, how=how, paths=[as_path(p) for p in paths], remover=remover, incremental=incremental or remover is not None))
        return self

    def roll(self, past: float, future: float, *paths: Path, how: Callable | None = None, step: Callable | None = None, distance: Path | None = None, scale: int = 1) -> Column:
        """``how(params)`` gives an aggregate over the window, ``step(acc, distance, params)`` a fold in order of ids."""
        self.define(Definition("roll", past=past, future=future, how=how, step=step, distance=None if distance is None else as_path(distance), scale=scale, paths=[as_path(p) for p in paths]))
        return self

    def _target(self) -> Table:
        if self.output is None:
            raise EngineError(ErrorCode.DEFINITION, f"{self} has no output table")
        return self.output

    def dependencies(self) -> list[Element]:
        d = self.definition
        if d is None:
            # a key is filled with its table
            return [self.table] if self.is_key and self.table.is_derived else []
        out: list[Element] = [self.table]
        start = self.table
        if d.kind == "accumulate":
            out.append(d.facts)
            start = d.facts
            out += self.schema.path(start, d.group)
        if d.kind == "roll" and d.distance:
            out += self.schema.path(start, d.distance)
        for p in d.paths:
            out += self.schema.path(start, p)
        if d.kind in ("link", "project", "link_range"):
            if d.kind == "link" or (d.kind == "link_range" and not d.grow):
                out.append(self._target())
            out += [self._target().column(k) for k in d.parts.get("keys", []) if d.kind == "link"]
        seen: dict = {}
        return [seen.setdefault(e.id, e) for e in out if e.id not in seen and e is not self]

    # data

    def df(self) -> DataFrame:
        """``(_id, name)`` after the last evaluation."""
        return self.table.df().select(ID, self.name)

    def value(self, row: int) -> Any:
        got = self.df().filter(F.col(ID) == row).first()
        return None if got is None else got[self.name]

    def lower_bound(self, value: Any) -> int:
        """Lowest id whose value is ``value`` or more, -1 if there is none."""
        got = self.df().filter(F.col(f"`{self.name}`") >= F.lit(value)).agg(F.min(ID)).first()[0]
        return -1 if got is None else got

    def set_values(self, value: Any, where: SparkColumn | None = None) -> None:
        """One value for all rows, or for those that hold a condition (over ``_id`` and other columns of the table's data)."""
        old = F.col(self.name) if self.name in self.table.data.columns else F.lit(None)
        new = F.lit(value).cast(self.kind)
        self.table.rewrites += 1
        self.table._change(self.table.data.withColumn(self.name, new if where is None else F.when(where, new).otherwise(old)))


class Table(Element):
    """Rows with ids; data comes from the user or from a product or range."""

    def __init__(self, schema: Schema, name: str):
        super().__init__()
        self.schema, self.name = schema, name
        self.data: DataFrame | None = None
        self.low = 0  # rows below were removed
        self.next_id = 0
        self.removed: tuple[int, int] = (0, 0)
        self.added: tuple[int, int] = (0, 0)
        self.id_column: str | None = None  # the column that the ids are taken from
        self.dense: bool | None = None  # whether ids have no gaps; None: not known
        self.rewrites = 0  # how often data changed otherwise than by adding and removing rows
        self.gone: DataFrame | None = None  # rows removed since the last evaluation

    def __repr__(self) -> str:
        return self.name

    def columns(self) -> list[Column]:
        return [c for c in self.schema.columns if c.table is self]

    def column(self, name: str) -> Column:
        for c in self.columns():
            if c.name == name:
                return c
        raise EngineError(ErrorCode.NAME_RESOLUTION, f"{self.name} has no column {name}")

    def key_columns(self) -> list[Column]:
        return [c for c in self.columns() if c.is_key]

    def projections(self) -> list[Column]:
        """Columns that add rows to this table."""
        return [c for c in self.schema.columns if c.output is self and c.definition is not None and (c.definition.kind == "project" or (c.definition.kind == "link_range" and c.definition.grow))]

    def range_definition(self) -> Range | None:
        return self.definition.range if self.definition is not None and self.definition.kind == "range" else None

    # definitions

    def noop(self) -> Table:
        self.define(None)
        return self

    def product(self, where: Callable | None = None) -> Table:
        """All combinations of the rows of the key columns' output tables, or, if columns project to the table, their distinct values.

        ``where`` gets a function from a path that begins with a key column to a Column.
        """
        self.define(Definition("product", where=where))
        return self

    def range(self, r: Range) -> Table:
        """Intervals; columns ``value`` and ``interval`` are made."""
        for name, kind in (("value", "double"), ("interval", "bigint")):
            if name not in [c.name for c in self.columns()]:
                self.schema.create_column(name, self, kind=kind).is_key = True
        self.define(Definition("range", range=r))
        return self

    def dependencies(self) -> list[Element]:
        out: list[Element] = []
        if self.definition is not None and self.definition.kind == "product":
            out += [c.output for c in self.key_columns() if c.output is not None and not self.projections()]
        # rows come from the projecting columns' inputs, and from the columns themselves
        for c in self.projections():
            out.append(c.table)
            for p in c.definition.paths:
                out += self.schema.path(c.table, p)
        seen: dict = {}
        return [seen.setdefault(e.id, e) for e in out if e.id not in seen and e is not self]

    # data

    def load(self, df: DataFrame, order_by: list[str] | None = None, id_column: str | None = None, dense: bool = True) -> Table:
        """Take a DataFrame as the table's data.

        Ids are those of ``id_column`` (whole numbers that grow in the order of
        the rows, none of them twice), or dense by ``order_by``, or by the order of
        the source; without ``dense`` the latter have gaps, which needs no
        numbering at all.  Rolls by row distance number gapped ids themselves.
        """
        if id_column is not None:
            data = df.withColumn(ID, F.col(f"`{id_column}`").cast("long"))
        elif order_by:
            data = with_ids(df, order_by)
        elif not dense:
            data = arrival_order(df, ID)
        else:
            data = arrival_ids(df)
        for f in df.schema.fields:
            if f.name not in [c.name for c in self.columns()]:
                self.schema.create_column(f.name, self, kind=f.dataType.simpleString())
        self.replace(data)
        self.id_column = id_column
        self.dense = True if id_column is None and (order_by or dense) else None
        self.low = self.next_id = 0
        self.added = self.removed = (0, 0)
        return self

    def replace(self, df: DataFrame) -> None:
        """Other data; ids may be any, so whether they are dense is looked up where it matters."""
        self.data, self.version = df, self.schema.tick()
        self.dense, self.id_column, self.gone = None, None, None
        self.rewrites += 1

    def _change(self, df: DataFrame) -> None:
        """Data with rows added, removed or changed in place; ids stay what they are."""
        self.data, self.version = df, self.schema.tick()

    def evaluated(self) -> None:
        """Forget what was added and removed; called after every evaluation."""
        self.added, self.removed, self.gone = (self.added[1], self.added[1]), (self.removed[1], self.removed[1]), None

    def add(self, rows: list[dict] | DataFrame) -> tuple[int, int]:
        """Append rows; missing columns get their defaults. Gives the range of the new ids."""
        own = [c for c in self.columns() if not c.is_derived]
        start = self._next()
        if isinstance(rows, DataFrame):
            new = arrival_ids(rows, start=start)
            n = new.count()
        else:
            kinds = ", ".join(f"`{c.name}` {c.kind}" for c in own)
            values = [tuple([start + i, *(r.get(c.name, c.default) for c in own)]) for i, r in enumerate(rows)]
            new, n = self.schema.spark.createDataFrame(values, f"{ID} long" + (", " + kinds if kinds else "")), len(rows)
        if self.data is None:
            self.dense = True
        self._change(new if self.data is None else self.data.unionByName(new, allowMissingColumns=True))
        self.next_id = start + n
        self.added = (self.added[0] if self.added[1] > self.added[0] else start, self.next_id)
        return start, self.next_id

    def _next(self) -> int:
        if self.next_id == 0 and self.data is not None:
            top = self.data.agg(F.max(ID)).first()[0]
            self.next_id = self.low if top is None else top + 1
        return self.next_id

    def remove(self, n: int | None = None) -> tuple[int, int]:
        """Drop the ``n`` oldest rows (all without ``n``), whatever gaps the ids have; gives the range of removed ids."""
        first = max(self.low, self.data.agg(F.min(ID)).first()[0] or 0)
        last = None if n is None else nth_id(self.data.filter(F.col(ID) >= first), n)
        return self._cut(first, self._next() if last is None else last)

    def remove_below(self, column: str, threshold: Any) -> int:
        """Drop the leading rows up to the first whose value reaches ``threshold``; gives their number."""
        first = max(self.low, self.data.agg(F.min(ID)).first()[0] or 0)
        live = self.data.filter(F.col(ID) >= self.low)
        reach = live.filter(F.col(column) >= F.lit(threshold)).agg(F.min(ID)).first()[0]
        return self._cut(first, self._next() if reach is None else reach)[1] - first

    def _cut(self, first: int, last: int) -> tuple[int, int]:
        self._next()
        self.low = last
        self.removed = (self.removed[0] if self.removed[1] > self.removed[0] else first, last)
        cut = self.data.filter(F.col(ID) < last)
        self.gone = cut if self.gone is None else self.gone.unionByName(cut, allowMissingColumns=True)
        self._change(self.data.filter(F.col(ID) >= last))
        return first, last

    def reset(self) -> None:
        """Forget all rows; ids begin at 0 again."""
        self.low = self.next_id = 0
        self.added = self.removed = (0, 0)
        self.replace(self.data.limit(0) if self.data is not None else None)

    def df(self) -> DataFrame:
        """The table with all evaluated columns."""
        got = self.schema.frames.get(self.name, self.data)
        if got is None:
            raise EngineError(ErrorCode.EVALUATION, f"{self.name} has no data")
        return got

    def length(self) -> int:
        return self.df().count()

    def id_range(self) -> tuple[int, int]:
        """Lowest live id and the next one to be given."""
        low, high = self.df().agg(F.min(ID), F.max(ID)).first()
        return (self.low, max(self.low, self.next_id)) if low is None else (low, high + 1)

    def changes(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Ranges of the ids added and removed since the last evaluation."""
        return self.added, self.removed

    def is_changed(self) -> bool:
        """Whether the data or a definition is newer than the last evaluation."""
        return self.version > self.schema.evaluated_at or any(c.version > self.schema.evaluated_at for c in self.columns())

    def find(self, values: dict[str, Any]) -> int:
        """Lowest id of a row with these values (null equals null), -1 if there is none."""
        cond = F.lit(True)
        for k, v in values.items():
            cond = cond & F.col(k).eqNullSafe(F.lit(v))
        got = self.df().filter(cond).agg(F.min(ID)).first()[0]
        return -1 if got is None else got

    def row(self, row_id: int, columns: list[str] | None = None) -> dict[str, Any] | None:
        got = self.df().filter(F.col(ID) == row_id).first()
        return None if got is None else {k: v for k, v in got.asDict().items() if k != ID and (columns is None or k in columns)}

    def set_row(self, row_id: int, values: dict[str, Any]) -> None:
        data = self.data
        for k, v in values.items():
            kind = self.column(k).kind
            old = F.col(k) if k in data.columns else F.lit(None).cast(kind)
            data = data.withColumn(k, F.when(F.col(ID) == row_id, F.lit(v).cast(kind)).otherwise(old))
        self.rewrites += 1
        self._change(data)


class Schema:
    """A catalog of tables and columns and the frames of their last evaluation."""

    def __init__(self, spark: SparkSession, name: str = "schema"):
        ship_package(spark)
        self.spark, self.name, self.id = spark, name, uuid.uuid4()
        self.tables: list[Table] = []
        self.columns: list[Column] = []
        self.frames: dict[str, DataFrame] = {}
        self.states: dict = {}  # what incremental columns were at the last evaluation
        self.clock = 0
        self.evaluated_at = -1

    def tick(self) -> int:
        self.clock += 1
        return self.clock

    def elements(self) -> list[Element]:
        return [*self.tables, *self.columns]

    def create_table(self, name: str) -> Table:
        """A table of this name; an existing one is given back."""
        for t in self.tables:
            if t.name == name:
                return t
        if name == OBJECT:
            raise EngineError(ErrorCode.ELEMENT_CREATION, f"{OBJECT} is the name of plain values")
        t = Table(self, name)
        self.tables.append(t)
        self.tick()
        return t

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name == name:
                return t
        raise EngineError(ErrorCode.NAME_RESOLUTION, f"no table {name}")

    def create_column(self, name: str, table: Table, output: Table | None = None, kind: str | None = None) -> Column:
        """A column of plain values of a Spark type (double unless named), or a link if ``output`` is given."""
        if name == ID or name in [c.name for c in table.columns()]:
            raise EngineError(ErrorCode.ELEMENT_CREATION, f"{table.name} has a column {name} already")
        c = Column(self, name, table, output, "bigint" if output is not None else kind or "double")
        self.columns.append(c)
        self.tick()
        return c

    def rename(self, element: Element, name: str) -> None:
        others = self.tables if isinstance(element, Table) else element.table.columns()
        if any(e.name == name for e in others if e is not element):
            raise EngineError(ErrorCode.ELEMENT_UPDATE, f"there is a {name} already")
        if element.dependents():
            raise EngineError(ErrorCode.ELEMENT_UPDATE, f"{element} is used by {element.dependents()}")
        if isinstance(element, Column) and element.table.data is not None and element.name in element.table.data.columns:
            element.table.rewrites += 1
            element.table.id_column = name if element.table.id_column == element.name else element.table.id_column
            element.table._change(element.table.data.withColumnRenamed(element.name, name))
        element.name = name
        element.version = self.tick()

    def delete_column(self, column: Column) -> None:
        used = [e for e in column.dependents() if e is not column.table]
        if used:
            raise EngineError(ErrorCode.ELEMENT_DELETE, f"{column} is used by {used}")
        self.columns.remove(column)
        if column.table.data is not None and column.name in column.table.data.columns:
            column.table.rewrites += 1
            column.table.id_column = None if column.table.id_column == column.name else column.table.id_column
            column.table._change(column.table.data.drop(column.name))
        self.tick()

    def delete_table(self, table: Table) -> None:
        """The table goes with the columns into and out of it."""
        self.columns = [c for c in self.columns if c.table is not table and c.output is not table]
        self.tables.remove(table)
        self.frames.pop(table.name, None)
        self.tick()

    def path(self, start: Table, names: Sequence[str]) -> list[Column]:
        """The columns of a path, each beginning where the one before leads."""
        out, table = [], start
        for i, n in enumerate(names):
            if table is None:
                raise EngineError(ErrorCode.NAME_RESOLUTION, f"{'.'.join(names[:i])} leads to no table")
            c = table.column(n)
            out.append(c)
            table = c.output
        return out

    def create_views(self, prefix: str = "") -> None:
        """Make the evaluated tables known to ``spark.sql`` under their names."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(prefix + name)

    def evaluate(self, *wanted: Element) -> None:
        """Bring the frames up to date: of all elements, or of ``wanted`` and what they depend on. Nothing runs yet."""
        from weftline.plans.planner import evaluate

        evaluate(self, list(wanted))
