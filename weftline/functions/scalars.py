"""Scalar helpers whose results are those of double arithmetic elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """Division with infinities and NaN for a zero divisor, as doubles have it; null if a side is null."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, b))


def to_number(x: Column) -> Column:
    """A value as a double: null and empty text are NaN, other text must be a number."""
    text = F.trim(x.cast("string"))
    return F.when(x.isNull() | (text == ""), F.lit(float("nan"))).otherwise(F.when(text == "", None).otherwise(text).cast("double"))


def epoch_seconds(x: Column) -> Column:
    """Seconds since 1970, with microseconds, of a timestamp (with or without a zone; UTC is meant)."""
    return F.unix_micros(x.cast("timestamp")) / F.lit(1_000_000.0)


def ordered_intersection(a: Column, b: Column) -> Column:
    """The distinct values of array ``a`` that ``b`` has too, in the order of ``a``."""
    return F.array_intersect(a, b)
