"""Aggregates of linked facts, put on the rows of an existing group table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ids import ID
from weftline.session import ship_package


@dataclass(frozen=True)
class Sum:
    """``default`` plus the sum of a value; ``sign`` -1 for taking facts away."""

    value: Column

    def aggregate(self) -> Column:
        return F.sum(self.value)

    def combine(self, default: Any, part: Column) -> Column:
        return F.lit(default) + F.coalesce(part, F.lit(0))


@dataclass(frozen=True)
class Count:
    """``default`` plus the number of facts (or of non-null values)."""

    value: Column | None = None

    def aggregate(self) -> Column:
        return F.count(F.lit(1) if self.value is None else self.value)

    def combine(self, default: Any, part: Column) -> Column:
        return F.lit(default) + F.coalesce(part, F.lit(0))


@dataclass(frozen=True)
class Plain:
    """Any aggregate expression (min, max, avg, a quotient of sums, ...); groups without facts keep the default."""

    expression: Column

    def aggregate(self) -> Column:
        return self.expression

    def combine(self, default: Any, part: Column) -> Column:
        return F.coalesce(part, F.lit(default))


def weighted_average(value: Column, weight: Column) -> Plain:
    return Plain(F.try_divide(F.sum(value * weight), F.sum(weight)))


@dataclass(frozen=True)
class Fold:
    """An ordered fold with a step written over Columns: ``step(accumulated, params)``, facts in order of ids.

    The facts of a group are brought together as an array, so groups should be
    of moderate size; ``StreamFold`` has no such limit.
    """

    step: Callable[[Column, list[Column]], Column]
    params: tuple[Column, ...]

    def run(self, facts: DataFrame, group: Column, order: str, default: Any, kind: str) -> DataFrame:
        names = [f"p{i}" for i in range(len(self.params))]
        rows = facts.select(group.alias("__g"), F.struct(F.col(order).alias("__o"), *(p.alias(n) for p, n in zip(self.params, names))).alias("__r")).filter("__g >= 0")
        lists = rows.groupBy("__g").agg(F.array_sort(F.collect_list("__r")).alias("__rs"))
        folded = F.aggregate("__rs", F.lit(default).cast(kind), lambda acc, r: self.step(acc, [r[n] for n in names]).cast(kind))
        return lists.select("__g", folded.alias("__part"))


@dataclass(frozen=True)
class StreamFold:
    """An ordered fold with a Python step ``step(accumulated, *params)``: sorted facts stream through, one accumulator is held per group."""

    step: Callable[..., Any]
    params: tuple[Column, ...]

    def run(self, facts: DataFrame, group: Column, order: str, default: Any, kind: str) -> DataFrame:
        names = [f"p{i}" for i in range(len(self.params))]
        rows = facts.select(group.alias("__g"), F.col(order).alias("__o"), *(p.alias(n) for p, n in zip(self.params, names))).filter("__g >= 0")
        ship_package(facts.sparkSession)
        rows = rows.repartition("__g").sortWithinPartitions("__g", "__o")
        step = self.step

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, acc = None, default
            for f in frames:
                done = []
                for g, *params in zip(f["__g"], *(f[n] for n in names)):
                    if g != current:
                        if current is not None:
                            done.append((current, acc))
                        current, acc = g, default
                    acc = step(acc, *params)
                if done:
                    yield pd.DataFrame(done, columns=["__g", "__part"])
            if current is not None:
                yield pd.DataFrame([(current, acc)], columns=["__g", "__part"])

        return rows.mapInPandas(fold, f"__g long, __part {kind}")


Aggregate = Sum | Count | Plain | Fold | StreamFold


@dataclass(frozen=True)
class Wanted:
    """A column to be accumulated: its name, aggregate, default and type."""

    name: str
    how: Aggregate
    default: Any = 0.0
    kind: str = "double"


def accumulate_all(groups: DataFrame, facts: DataFrame, group: Column, wanted: list[Wanted], order: str = ID) -> DataFrame:
    """``groups`` with a column for each of ``wanted``, over the facts whose ``group`` is the row's id.

    Facts with a null or negative group are left out, groups without facts have
    the default.  Facts are aggregated before they meet the groups: in one pass
    and one join for all aggregates, and one more for every fold.
    """
    names = {w.name for w in wanted}
    kept = groups.select(*(F.col(f"`{c}`") for c in groups.columns if c not in names))
    values: dict[str, Column] = {}
    plain = [w for w in wanted if not isinstance(w.how, (Fold, StreamFold))]
    if plain:
        parts = facts.withColumn("__g", group).filter("__g >= 0").groupBy("__g").agg(*(w.how.aggregate().alias(f"__part{i}") for i, w in enumerate(plain)))
        kept = kept.join(parts, kept[ID] == parts["__g"], "left").drop("__g")
        values |= {w.name: w.how.combine(w.default, F.col(f"__part{i}")) for i, w in enumerate(plain)}
    for i, w in enumerate(w for w in wanted if w not in plain):
        parts = w.how.run(facts, group, order, w.default, w.kind).select(F.col("__g").alias("__fg"), F.col("__part").alias(f"__fold{i}"))
        kept = kept.join(parts, kept[ID] == parts["__fg"], "left").drop("__fg")
        values[w.name] = F.coalesce(f"__fold{i}", F.lit(w.default))
    return kept.select(*(F.col(f"`{c}`") for c in groups.columns if c not in names), *(values[w.name].cast(w.kind).alias(w.name) for w in wanted))


def accumulate(groups: DataFrame, facts: DataFrame, group: Column, how: Aggregate, name: str, default: Any, kind: str = "double", order: str = ID) -> DataFrame:
    """``accumulate_all`` for a single column."""
    return accumulate_all(groups, facts, group, [Wanted(name, how, default, kind)], order)


def accumulate_delta(groups: DataFrame, name: str, group: Column, how: Sum | Count, added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """The column brought up to date from the facts added and removed since; everything else is untouched."""
    out = groups
    for facts, sign in ((removed, -1), (added, 1)):
        if facts is None:
            continue
        parts = facts.withColumn("__g", group).filter("__g >= 0").groupBy("__g").agg(how.aggregate().alias("__part"))
        changed = (F.col(f"`{name}`") + F.lit(sign) * F.coalesce("__part", F.lit(0))).cast(out.schema[name].dataType)
        out = out.join(parts, out[ID] == parts["__g"], "left").withColumn(name, changed).drop("__g", "__part")
    return out
