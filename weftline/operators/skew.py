"""Aggregation per key when a few keys hold most rows.

``tree_aggregate`` combines every input split locally, then merges the states in
rounds of a bounded fan-in: a key's partial states are first grouped by
``split // fan_in``, then by ``split // fan_in**2`` and so on, so that no task
ever gets more than about ``fan_in`` states of one key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import chunk_count

#: A double is cut into whole numbers below 2**30, counted in these units, so that sums of them are exact in any order.
UNITS = (60, 30, 0, -30, -60)
BASE = 1 << 30
#: Magnitudes from here on are added up as doubles beside, as are what is left below the last unit.
HUGE = 2.0**90


@dataclass(frozen=True)
class Measure:
    """One mergeable state: kind is count, sum, min or max; ``value`` is unused for count."""

    name: str
    kind: str
    value: Column | None = None

    def leaf(self) -> list[Column]:
        """The state of a single row, as one or more columns."""
        if self.kind == "count":
            return [F.lit(1).cast("long") if self.value is None else F.when(self.value.isNotNull(), 1).otherwise(0).cast("long")]
        if self.kind != "sum":
            return [self.value]
        x = self.value.cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        rest, out = F.when(finite & (F.abs(x) < HUGE), x).otherwise(0.0), []
        for u in UNITS:  # exact: each step takes the leading bits off
            part = (rest / F.lit(2.0**u)).cast("long")
            out.append(part)
            rest = rest - part.cast("double") * F.lit(2.0**u)
        beside = rest + F.when(finite & (F.abs(x) >= HUGE), x).otherwise(0.0)
        return [*out, beside, finite.cast("long")]

    def merge(self, state: list[Column], wide: bool) -> list[Column]:
        """States of a key into one; ``wide`` where a count of rows could be beyond what whole numbers below 2**30 allow in 64 bits."""
        if self.kind in ("min", "max"):
            return [{"min": F.min, "max": F.max}[self.kind](state[0])]
        if self.kind == "count":
            return [F.sum(state[0])]
        parts = [F.sum(c.cast("decimal(28,0)") if wide else c) for c in state[: len(UNITS)]]
        return [*parts, F.sum(state[-2]), F.sum(state[-1])]

    def result(self, state: list[Column]) -> Column:
        if self.kind != "sum":
            return state[0]
        digits, carry = [], F.lit(0).cast("decimal(38,0)")
        for c in reversed(state[1 : len(UNITS)]):  # carry from the smallest unit up, so that what is added below is exact
            whole = c.cast("decimal(38,0)") + carry
            carry = F.floor(whole.cast("decimal(38,0)") / F.lit(BASE).cast("decimal(38,0)")).cast("decimal(38,0)")
            digits.append((whole - carry * F.lit(BASE)).cast("double"))
        total = (state[0].cast("decimal(38,0)") + carry).cast("double") * F.lit(2.0 ** UNITS[0])
        for d, u in zip(reversed(digits), UNITS[1:]):
            total = total + d * F.lit(2.0**u)
        return F.when(state[-1] > 0, total + state[-2])


def tree_rounds(chunks: int, fan_in: int) -> int:
    """Rounds that bring ``chunks`` partial states of a key down to one; two at least."""
    return max(2, math.ceil(math.log(max(2, chunks)) / math.log(fan_in)))


def tree_aggregate(df: DataFrame, keys: list[str], measures: list[Measure], fan_in: int = 32, rounds: int | None = None) -> DataFrame:
    """Aggregate ``measures`` by ``keys`` through a tree of bounded fan-in.

    Defined results: null keys form a group of their own; null and non-finite
    values are left out of sums (a group with nothing to add has a null sum) and
    nulls out of min and max; copies count as rows; an empty table gives an
    empty result; other columns of ``df`` are ignored, whatever their names.
    Sums are doubles: values from 2**-60 to 2**90 are added exactly, in whatever
    order they are merged, and larger and smaller parts as doubles, so none is
    lost.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    if rounds is None:
        rounds = tree_rounds(chunk_count(df), fan_in)
    ks = [f"__k{i}" for i in range(len(keys))]
    leaves = [m.leaf() for m in measures]
    ms = [[f"__m{i}_{j}" for j in range(len(leaf))] for i, leaf in enumerate(leaves)]
    state = df.select(
        *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, ks)),
        *(c.alias(n) for leaf, names in zip(leaves, ms) for c, n in zip(leaf, names)),
        F.spark_partition_id().cast("long").alias("__slot"),
    )

    def merged(wide: bool) -> list[Column]:
        return [c.alias(n) for m, names in zip(measures, ms) for c, n in zip(m.merge([F.col(n) for n in names], wide), names)]

    for k in range(rounds - 1):
        # map-side partial aggregation is the local combine; the exchange sees (key, slot) states only
        state = state.withColumn("__slot", F.floor(F.col("__slot") / fan_in)).groupBy(*ks, "__slot").agg(*merged(k > 0))
    state = state.groupBy(*ks).agg(*merged(True))
    return state.select(
        *(F.col(n).alias(k) for k, n in zip(keys, ks)), *(m.result([F.col(n) for n in names]).alias(m.name) for m, names in zip(measures, ms))
    )


def product_totals(order_items: DataFrame, fan_in: int = 32) -> DataFrame:
    """Row count, total quantity and revenue of every product id (null included)."""
    revenue = F.col("quantity") * F.col("unit_price")
    return tree_aggregate(
        order_items,
        ["product_id"],
        [Measure("n_rows", "count"), Measure("total_quantity", "sum", F.col("quantity")), Measure("revenue", "sum", revenue)],
        fan_in,
    )


def heavy_keys(df: DataFrame, key: str, parts: int, fan_in: int = 32) -> DataFrame:
    """Non-null keys that hold at least one in ``parts`` of all rows of ``df``, with their row count.

    At most ``parts`` rows come out, whatever the size of ``df``.  All rows count
    for the total, those with a null key too; it is counted by a scan that reads no
    column.
    """
    counts = tree_aggregate(df, [key], [Measure("n_rows", "count")], fan_in)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.filter(F.col(f"`{key}`").isNotNull() & (F.col("n_rows") * F.lit(parts) >= total))
