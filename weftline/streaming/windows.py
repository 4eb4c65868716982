"""Windows over event time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranges import DurationRange


def tumbling(df: DataFrame, time: str, duration: str, *aggregates: Column, origin: str | None = None, watermark: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Aggregates per interval (and keys); works on tables and streams. Intervals without rows do not come out."""
    d = df.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, watermark) if watermark else d
    w = F.window(time, duration, duration, origin) if origin else F.window(time, duration)
    return d.groupBy(w.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *(F.col(c) for c in _names(aggregates)))


def _names(aggregates: tuple[Column, ...]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggregates]


def filled(df: DataFrame, start: dt.datetime, period: dt.timedelta, length: int, defaults: dict) -> DataFrame:
    """The intervals of a range with what ``df`` (column ``start``) has of them; those without rows get defaults."""
    from weftline.operators.ranges import range_table

    r = DurationRange(start, period, length)
    table = range_table(df.sparkSession, r).select(F.col("value").alias("start"), "interval")
    return table.join(df, "start", "left").fillna(defaults)


def sliding_average(df: DataFrame, value: Column, past: int, name: str, divisor: int | None = None) -> DataFrame:
    """Over the last ``past`` rows by id: the average, or the sum over a fixed divisor (also where fewer rows exist)."""
    from weftline.operators.roll import roll

    how = F.avg(value) if divisor is None else F.sum(value / F.lit(float(divisor)))
    return roll(df, past, 0, name, how)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, watermark: str | None = None) -> DataFrame:
    """Aggregates per session: rows of a key with no gap as long as ``gap`` between them."""
    d = df.withColumn(time, F.col(time).cast("timestamp"))
    d = d.withWatermark(time, watermark) if watermark else d
    w = F.session_window(time, gap)
    return d.groupBy(w.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *(F.col(c) for c in _names(aggregates)))
