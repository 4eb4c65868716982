"""From definitions to DataFrames: layers of elements, each built on those before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import EngineError, ErrorCode
from weftline.functions.formula import Formula
from weftline.model import Column, Definition, Element, Schema, Table, as_path
from weftline.operators.accumulate import Count, Sum, Wanted, accumulate_all
from weftline.operators.ids import ID
from weftline.operators.link import link, project
from weftline.operators.product import product
from weftline.operators.ranges import interval_link, project_range, range_table
from weftline.operators.roll import roll, roll_by
from weftline.session import materialise


def layers(schema: Schema, wanted: list[Element] | None = None) -> list[list[Element]]:
    """Elements in layers, each depending on earlier ones only; with ``wanted``, only what these need."""
    todo: dict = {}
    stack = list(wanted or schema.elements())
    while stack:
        e = stack.pop()
        if e.id not in todo:
            todo[e.id] = e
            stack += e.dependencies()
            if isinstance(e, Column):
                stack.append(e.table)
            if isinstance(e, Table):
                stack += e.projections()
    # a column of a derived table also waits for the table; a projection fills its target with itself
    needs = {i: {d.id for d in e.dependencies()} for i, e in todo.items()}
    for i, e in todo.items():
        if isinstance(e, Column) and e.definition is not None and e.definition.kind in ("project", "link_range"):
            needs[i].add(e.output.id)
        if isinstance(e, Column):
            needs[i].add(e.table.id)
        needs[i] &= {*todo}
    out: list[list[Element]] = []
    done: set = set()
    while len(done) < len(todo):
        ready = [e for i, e in todo.items() if i not in done and needs[i] <= done]
        if not ready:
            raise EngineError(ErrorCode.DEFINITION, f"these wait for each other: {[e for i, e in todo.items() if i not in done]}")
        out.append(ready)
        done |= {e.id for e in ready}
    return out


def carried(schema: Schema, elements: list[Element]) -> dict:
    """For every link column the ends of paths that some definition follows beyond it."""
    wanted: dict = {}
    for e in elements:
        d = e.definition
        if not isinstance(e, Column) or d is None:
            continue
        start = d.facts if d.kind == "accumulate" else e.table
        for p in [*d.paths, *([d.group] if d.kind == "accumulate" else []), *([d.distance] if d.kind == "roll" and d.distance else [])]:
            try:
                cols = schema.path(start, p)
            except EngineError:
                continue  # reported where the definition is evaluated
            for i, c in enumerate(cols[:-1]):
                wanted.setdefault(c.id, set()).add(tuple(p[i + 1 :]))
    return wanted


def in_order(layer: list[Element]) -> list[Element]:
    """A layer with the columns of a table before the links that lead to it, so that these can carry their values."""
    out: list[Element] = [e for e in layer if isinstance(e, Table)]
    todo = [e for e in layer if isinstance(e, Column)]
    while todo:
        busy = {e.table.id for e in todo}
        ready = [e for e in todo if e.definition is None or e.definition.kind not in ("link", "project") or e.output.id not in busy - {e.table.id}] or todo[:1]
        out += ready
        todo = [e for e in todo if e not in ready]
    return out


VIA = "__via."


class Frames:
    """The DataFrames of an evaluation under way.

    Beside the columns of its table, a frame may hold columns that a link has
    brought along from its target (named ``VIA`` and the path), so that following
    a path costs no other join than that of the link.
    """

    def __init__(self, schema: Schema, wanted: dict | None = None):
        self.schema = schema
        self.df: dict[str, DataFrame] = {}
        self.grown: dict = {}  # facts that a projection to a range has linked already
        self.wanted = wanted or {}
        self.versions: dict[str, list[tuple[set, DataFrame]]] = {}

    def note(self, t: Table, *done: str) -> None:
        """Remember the frame of a table as it is now, and which of its columns are final."""
        if t.name not in self.df:
            return
        seen = self.versions.setdefault(t.name, [])
        if not seen:
            final = {ID, *(n for n in self.df[t.name].columns if not any(c.name == n and c.definition is not None for c in t.columns()))}
        else:
            final = seen[-1][0] | {n for n in self.df[t.name].columns if n.startswith(VIA)} | {*done}
        seen.append((final, self.df[t.name]))

    def lean(self, t: Table, columns: set[str]) -> DataFrame:
        """The earliest frame of a table that has some final columns: the joins of later ones aren't part of it."""
        return next((df for final, df in self.versions.get(t.name, ()) if columns <= final), self.df[t.name])

    def source(self, t: Table, paths: list[tuple[str, ...]]) -> DataFrame:
        """The leanest frame from which paths can be followed."""
        full = self.df[t.name]
        return self.lean(t, {ID, *(self.at_hand(full, p) or p[0] for p in paths)})

    def at_hand(self, df: DataFrame, path: tuple[str, ...]) -> str | None:
        """The column of ``df`` that holds what a path leads to, if there is one."""
        name = path[0] if len(path) == 1 else VIA + ".".join(path)
        return name if name in df.columns else None

    def with_paths(self, table: Table, df: DataFrame, paths: list[tuple[str, ...]]) -> tuple[DataFrame, list[SparkColumn]]:
        """``df`` with what the paths reach, and a Column per path.

        What a link has carried along is at hand; other paths are followed from
        their far end, so that ``df`` is joined once per link of its own.
        """
        for p in paths:
            self.schema.path(table, p)
        far: dict[str, list[tuple[str, ...]]] = {}
        for p in dict.fromkeys(paths):
            if len(p) > 1 and self.at_hand(df, p) is None:
                far.setdefault(p[0], []).append(p[1:])
        places = {p: self.at_hand(df, p) for p in paths}
        for k, (link_name, ends) in enumerate(far.items()):
            target = table.column(link_name).output
            side, values = self.with_paths(target, self.source(target, ends), ends)
            tag = f"__p{k}_"
            side = side.select(F.col(ID).alias(f"{tag}{ID}"), *(v.alias(f"{tag}{i}") for i, v in enumerate(values)))
            df = df.join(side, F.col(f"`{link_name}`") == F.col(f"{tag}{ID}"), "left")
            places |= {(link_name, *e): f"{tag}{i}" for i, e in enumerate(ends)}
        return df, [F.col(f"`{places[p]}`") for p in paths]

    def link_target(self, c: Column, keys: list[str]) -> tuple[DataFrame, dict[str, str], bool]:
        """The frame a link leads to, the columns it should bring along (new name -> name there), and whether its keys are unique."""
        u = c.output
        df = self.df[u.name]
        bring = {VIA + ".".join((c.name, *end)): at for end in sorted(self.wanted.get(c.id, ())) if (at := self.at_hand(df, end)) is not None}
        df = self.lean(u, {ID, *keys, *bring.values()})
        projected = c.definition.kind == "project" and set(keys) == {k.name for k in u.key_columns()}
        return df, bring, projected or (len(keys) == 1 and keys[0] == u.id_column)

    def table(self, t: Table) -> None:
        d = t.definition
        if d is None:
            if t.data is not None:
                self.df[t.name] = t.data
            return
        if d.kind == "range":
            growing = [c for c in t.projections()]
            if not growing:
                self.df[t.name] = range_table(self.schema.spark, d.range)
                return
            if len(growing) > 1:
                raise EngineError(ErrorCode.DEFINITION, f"several columns project to the range {t}")
            c = growing[0]
            df, (x,) = self.with_paths(c.table, self.source(c.table, c.definition.paths), c.definition.paths)
            self.df[t.name], linked = project_range(df, x, d.range, c.name)
            self.grown[c.id] = linked.select(ID, f"`{c.name}`")
            return
        growing = t.projections()
        if not growing:
            keys = t.key_columns()
            if any(k.output is None for k in keys):
                raise EngineError(ErrorCode.DEFINITION, f"a key of {t} leads to no table, and nothing projects to it")
            sides, where = self.condition_sides(t, keys, d)
            self.df[t.name] = product(sides, where)
            return
        got = None
        for c in growing:
            df, values = self.with_paths(c.table, self.source(c.table, c.definition.paths), c.definition.paths)
            got = project(df, values, c.definition.keys, keep=lambda first: self.restricted(t, first, d), existing=got)
        self.df[t.name] = got

    def condition_paths(self, t: Table, d: Definition) -> list[tuple[str, ...]]:
        paths: list[tuple[str, ...]] = []

        def note(p):
            names = as_path(p)
            if not t.column(names[0]).is_key:
                raise EngineError(ErrorCode.DEFINITION, f"a condition on {t} must begin with a key column, not {names[0]}")
            if names not in paths:
                paths.append(names)
            return F.lit(None)

        d.where(note)
        return paths

    def condition_sides(self, t: Table, keys: list[Column], d: Definition) -> tuple[dict[str, DataFrame], SparkColumn | None]:
        """The key tables of a product with what its condition needs of each, and the condition over them."""
        paths = [] if d.where is None else self.condition_paths(t, d)
        sides, places = {}, {(k.name,): f"{k.name}.{ID}" for k in keys}
        for k in keys:
            ends = [p[1:] for p in paths if p[0] == k.name and len(p) > 1]
            df, values = self.with_paths(k.output, self.source(k.output, ends), ends)
            sides[k.name] = df.select(ID, *(v.alias(f"w{i}") for i, v in enumerate(values)))
            places |= {(k.name, *e): f"{k.name}.w{i}" for i, e in enumerate(ends)}
        return sides, None if d.where is None else d.where(lambda p: F.col(f"`{places[as_path(p)]}`"))

    def restricted(self, t: Table, df: DataFrame, d: Definition) -> DataFrame:
        """The rows that hold the condition of a table."""
        if d.where is None:
            return df
        paths = self.condition_paths(t, d)
        joined, values = self.with_paths(t, df, paths)
        return joined.filter(d.where(lambda p: values[paths.index(as_path(p))])).select(*(f"`{c}`" for c in df.columns))

    def column(self, c: Column) -> None:
        d, t = c.definition, c.table
        if d is None:
            if t.name in self.df and c.name not in self.df[t.name].columns:
                self.df[t.name] = self.df[t.name].withColumn(c.name, F.lit(c.default).cast(c.kind))
            return
        df = self.df[t.name]
        keep = [f"`{n}`" for n in df.columns if n != c.name]
        if d.kind == "calculate":
            self.df[t.name] = self.calculated(c, d, df, keep)
        elif d.kind in ("link", "project"):
            joined, values = self.with_paths(t, df, d.paths)
            target, bring, unique = self.link_target(c, d.keys)
            keep = [k for k in keep if not k.startswith(f"`{VIA}{c.name}.")]
            self.df[t.name] = link(joined, values, target, d.keys, c.name, bring, unique).select(*keep, f"`{c.name}`", *(f"`{b}`" for b in bring))
        elif d.kind == "link_range":
            r = c.output.range_definition()
            if c.id in self.grown:
                linked = self.grown[c.id]
                # other columns may have come meanwhile
                self.df[t.name] = df.drop(c.name).join(linked.select(ID, c.name), ID, "left").select(*keep, c.name)
            else:
                joined, (x,) = self.with_paths(t, df, d.paths)
                self.df[t.name] = joined.select(*keep, interval_link(x, r).alias(c.name))
        elif d.kind == "accumulate":
            self.accumulates([c])
        elif d.kind == "roll":
            joined, values = self.with_paths(t, df, ([d.distance] if d.distance else []) + d.paths)
            distance, params = (values[0], values[1:]) if d.distance else (None, values)
            default = c.default if c.default is not None else 0.0
            how = d.how(params) if d.how else None
            if distance is None:
                got = roll(joined, int(d.past), int(d.future), c.name, how, d.step, params, default, c.kind, dense=True if t.is_derived else t.dense)
            else:
                got = roll_by(joined, distance, d.past, d.future, c.name, how, d.step, params, default, c.kind, d.scale)
            self.df[t.name] = got.select(*keep, c.name)

    def accumulates(self, columns: list[Column]) -> None:
        """Accumulate columns of one table over the same facts by the same path: one aggregation and one join for all."""
        t, d = columns[0].table, columns[0].definition
        if all(c.definition.incremental for c in columns):
            return self.updated(columns)
        paths = list(dict.fromkeys(p for c in columns for p in c.definition.paths))
        facts, (group, *params) = self.with_paths(d.facts, self.source(d.facts, [d.group, *paths]), [d.group, *paths])
        at = dict(zip(paths, params))
        wanted = [Wanted(c.name, c.definition.how([at[p] for p in c.definition.paths]), c.default if c.default is not None else 0.0, c.kind) for c in columns]
        self.df[t.name] = accumulate_all(self.df[t.name], facts, group, wanted)

    # incremental accumulation

    def on_rows(self, t: Table, rows: DataFrame, paths: list[tuple[str, ...]]) -> DataFrame:
        """Some rows of a table with the columns that paths begin with, computed for these rows alone."""
        part = Frames(self.schema, self.wanted)
        part.df, part.versions, part.grown = {**self.df, t.name: rows}, {k: v for k, v in self.versions.items() if k != t.name}, self.grown
        needed: dict = {}
        stack = [t.column(p[0]) for p in paths]
        while stack:
            c = stack.pop()
            if c.table is t and c.id not in needed:
                needed[c.id] = c
                stack += [e for e in c.dependencies() if isinstance(e, Column)]
        for layer in layers(self.schema, list(needed.values())):
            for c in in_order(layer):
                if c.id in needed:
                    part.column(c)
        return part.df[t.name]

    def updated(self, columns: list[Column]) -> None:
        """The columns from their state at the last evaluation and the facts added and removed since.

        The state has a row per group with facts and is written down at every
        evaluation.  It is built anew from all facts if there is none yet or if
        anything but added and removed facts has changed.
        """
        t, d, schema = columns[0].table, columns[0].definition, self.schema
        facts_table, key = d.facts, (t.id, d.facts.id, d.group, tuple(c.id for c in columns))
        paths = list(dict.fromkeys(p for c in columns for p in c.definition.paths))

        def parts(rows: DataFrame, removed: bool) -> DataFrame:
            facts, (group, *params) = self.with_paths(facts_table, self.on_rows(facts_table, rows, [d.group, *paths]), [d.group, *paths])
            at, values = dict(zip(paths, params)), []
            for i, c in enumerate(columns):
                how = c.definition.remover if removed and c.definition.remover else c.definition.how
                agg = how([at[p] for p in c.definition.paths])
                if not isinstance(agg, (Sum, Count)):
                    raise EngineError(ErrorCode.DEFINITION, f"{c}: only sums and counts are kept up to date, use a plain accumulation")
                sign = -1 if removed and not c.definition.remover else 1
                values.append((F.coalesce(agg.aggregate(), F.lit(0)) * F.lit(sign)).alias(f"p{i}"))
            return facts.withColumn("__g", group).filter("__g >= 0").groupBy("__g").agg(*values)

        others = {e.id: e for c in columns for e in [c, *c.dependencies()]}
        stack = list(others.values())
        while stack:
            for e in stack.pop().dependencies():
                if e.id not in others:
                    others[e.id] = e
                    stack.append(e)
        shape = (facts_table.rewrites, tuple(sorted((str(i), e.version) for i, e in others.items() if e is not facts_table)))
        rowwise = all(e.definition is None or e.definition.kind in ("calculate", "link") or (e.definition.kind == "link_range" and not e.definition.grow) or e in columns for e in others.values() if isinstance(e, Column) and e.table in (facts_table, t))
        if not rowwise:
            raise EngineError(ErrorCode.DEFINITION, f"{columns[0]}: what the facts need is not computed row by row, use a plain accumulation")
        old = schema.states.get(key)
        if old is not None and old["shape"] == shape:
            changes = [old["parts"]]
            added = facts_table.data.filter(F.col(ID) >= max(old["upto"], facts_table.low))
            changes.append(parts(added, False))
            if facts_table.gone is not None:
                # what came and went since the last evaluation was never counted
                changes.append(parts(facts_table.gone.filter(F.col(ID) < old["upto"]), True))
            got = changes[0]
            for x in changes[1:]:
                got = got.unionByName(x)
            got = got.groupBy("__g").agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in range(len(columns))))
        else:
            got = parts(facts_table.data, False)
        state = materialise(got, "state")
        schema.states[key] = {"shape": shape, "parts": state, "upto": facts_table._next()}
        kept = self.df[t.name].select(*(f"`{n}`" for n in self.df[t.name].columns if n not in {c.name for c in columns}))
        joined = kept.join(state, F.col(ID) == F.col("__g"), "left")
        self.df[t.name] = joined.select(*(f"`{n}`" for n in kept.columns), *((F.lit(c.default if c.default is not None else 0) + F.coalesce(F.col(f"p{i}"), F.lit(0))).cast(c.kind).alias(c.name) for i, c in enumerate(columns)))

    def calculated(self, c: Column, d: Definition, df: DataFrame, keep: list[str]) -> DataFrame:
        if d.fn is None:
            return df.select(*keep, F.lit(c.default).cast(c.kind).alias(c.name))
        joined, values = self.with_paths(c.table, df, d.paths)
        if d.udf:
            fn, whole = d.fn, d.udf == "series"

            def call(*series: pd.Series) -> pd.Series:
                if whole:
                    return fn(list(series))
                return pd.Series([fn(list(row)) for row in zip(*series)], dtype=object)

            value = F.pandas_udf(call, c.kind)(*values)
        else:
            try:
                if isinstance(d.fn, Formula):
                    types = joined.select(*(v.alias(f"c{i}") for i, v in enumerate(values))).schema.fields
                    numbers = frozenset(p for p, f in zip(d.paths, types) if isinstance(f.dataType, T.NumericType))
                    value = d.fn.column(lambda p: values[d.paths.index(p)], None, numbers)
                else:
                    value = d.fn(values)
            except Exception as e:
                raise EngineError(ErrorCode.DEFINITION, f"{c}: the function doesn't work on Columns", f"{e}; use F.when, F.exp and the like, or udf=True") from e
            value = value if isinstance(value, SparkColumn) else F.lit(value)
        return joined.select(*keep, value.cast(c.kind).alias(c.name))


def _together(layer: list[Element]) -> list[list[Element]]:
    """Accumulate columns that share table, facts and group path are one step; all else is a step of its own."""
    out: list[list[Element]] = []
    at: dict = {}
    for e in layer:
        d = e.definition
        key = (e.table.id, d.facts.id, d.group) if isinstance(e, Column) and d is not None and d.kind == "accumulate" else e.id
        if key in at:
            out[at[key]].append(e)
        else:
            at[key] = len(out)
            out.append([e])
    return out


def evaluate(schema: Schema, wanted: list[Element]) -> None:
    """Build the frames anew, unless nothing has changed; elements that fail keep their error, and what needs them is skipped."""
    if not wanted and schema.evaluated_at == schema.clock:
        return
    order = layers(schema, wanted)
    frames, failed = Frames(schema, carried(schema, [e for layer in order for e in layer])), set()

    def attempt(step: list[Element]) -> bool:
        try:
            if len(step) > 1:
                frames.accumulates(step)
            else:
                frames.table(step[0]) if isinstance(step[0], Table) else frames.column(step[0])
            if isinstance(step[0], Table):
                frames.note(step[0])
            else:
                frames.note(step[0].table, *(e.name for e in step))
            return True
        except Exception as x:  # noqa: BLE001
            if len(step) == 1:
                step[0].errors.append(x)
                failed.add(step[0].id)
            return False

    for layer in order:
        for step in _together(in_order(layer)):
            for e in step:
                e.errors = []
            lame = [e for e in step if any(d.id in failed for d in e.dependencies())]
            failed |= {e.id for e in lame}
            sound = [e for e in step if e not in lame]
            if sound and not attempt(sound) and len(sound) > 1:
                for e in sound:  # one of them fails: each for itself
                    attempt([e])
    schema.frames |= {name: df.select(*(f"`{c}`" for c in df.columns if not c.startswith(VIA))) for name, df in frames.df.items()}
    for t in schema.tables:
        t.evaluated()
    if not wanted:
        schema.evaluated_at = schema.clock
    first = next((x for e in schema.elements() for x in e.errors), None)
    if first is not None:
        raise first
