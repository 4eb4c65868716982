"""Aggregates over neighbouring rows, by row distance or by the distance of a column.

The window of row i holds the rows j with i - j < past and j - i <= future.
Rows are cut into blocks by position, each block getting copies of the rows
just outside that its windows reach, so that no window function runs over the
whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.operators.ids import ID, is_dense, with_ids

#: Positions (rows or units of distance, in multiples of the window) per block.
ROWS_PER_BLOCK, WINDOWS_PER_BLOCK = 100_000, 200


def _blocks(df: DataFrame, position: Column, before: int, after: int, size: int) -> DataFrame:
    """Copies of the rows for every block whose windows reach them; ``__home`` is a row's own block."""
    at = df.withColumn("__at", position).filter("__at is not null").withColumn("__home", F.floor(F.col("__at") / size))
    low = F.floor((F.col("__at") - after) / size)
    high = F.floor((F.col("__at") + before) / size)
    return at.withColumn("__block", F.explode(F.sequence(low, high)))


def _finish(df: DataFrame, blocks: DataFrame, value: Column, name: str, default: Any, kind: str) -> DataFrame:
    done = blocks.withColumn("__value", value).filter(F.col("__home") == F.col("__block"))
    keep = [c for c in df.columns if c != name]
    return done.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("__value").cast(kind), F.lit(default).cast(kind)).alias(name))


def _frame_value(window, position: Column, how: Column | None, step, params: list[Column], default: Any, kind: str, scale: float) -> Column:
    if how is not None:
        return how.over(window)
    names = [f"p{i}" for i in range(len(params))]
    items = F.collect_list(F.struct(position.alias("at"), F.col(ID).alias("i"), *(p.alias(n) for p, n in zip(params, names)))).over(window)
    here = position
    return F.aggregate(
        F.sort_array(items), F.lit(default).cast(kind),
        lambda acc, r: step(acc, (F.abs(here - r["at"]) / F.lit(scale)).cast("double"), [r[n] for n in names]).cast(kind),
    )


def roll(df: DataFrame, past: int, future: int, name: str, how: Column | None = None, step: Callable | None = None, params: list[Column] = (), default: Any = 0.0, kind: str = "double", rows_per_block: int = ROWS_PER_BLOCK, dense: bool | None = None) -> DataFrame:
    """Window by row distance: ``how`` is one aggregate function, or ``step(acc, distance, params)`` a fold in order of ids.

    Rows count, not ids: unless ids are known to be ``dense``, gaps are looked
    for, and where there are any the rows are numbered first.
    """
    if past < 0 or future < 0 or (how is None) == (step is None):
        raise EngineError(ErrorCode.DEFINITION, "a roll needs sizes of 0 or more and either an aggregate or a step")
    if past == 0 and future == 0:
        return df.withColumn(name, F.lit(default).cast(kind))
    before, after = max(0, past - 1), future
    at = df
    if not dense and not is_dense(df):
        params = list(params)
        at = with_ids(df, [ID], "__row", unique=True)
    blocks = _blocks(at, F.col("__row" if at is not df else ID), before, after, max(rows_per_block, before + after + 1))
    w = Window.partitionBy("__block").orderBy("__at").rowsBetween(1 - past, future)
    return _finish(df, blocks, _frame_value(w, F.col("__at"), how, step, list(params), default, kind, 1.0), name, default, kind)


def roll_by(df: DataFrame, distance: Column, past: float, future: float, name: str, how: Column | None = None, step: Callable | None = None, params: list[Column] = (), default: Any = 0.0, kind: str = "double", scale: int = 1, windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """Window by the distance of a column, which must not decrease with the ids.

    ``scale`` turns distances into whole numbers, on which "less than past" is
    exact: 1 for whole numbers, 1_000_000 for seconds with micros.  Rows at the
    same distance are in each other's windows; rows without a distance are left out.
    """
    if past < 0 or future < 0 or (how is None) == (step is None):
        raise EngineError(ErrorCode.DEFINITION, "a roll needs sizes of 0 or more and either an aggregate or a step")
    reach, ahead = round(past * scale), round(future * scale)
    position = F.round(distance * scale).cast("long")
    before, after = max(0, reach - 1), ahead
    blocks = _blocks(df, position, before, after, max(1, before + after + 1) * windows_per_block)
    w = Window.partitionBy("__block").orderBy("__at").rangeBetween(1 - reach, ahead)
    return _finish(df, blocks, _frame_value(w, F.col("__at"), how, step, list(params), default, kind, float(scale)), name, default, kind)
