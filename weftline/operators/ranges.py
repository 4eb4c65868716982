"""Tables of intervals, and links of values to them by arithmetic instead of search."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.operators.ids import ID

#: Calendar ranges list their starts on the driver.
MOST_CALENDAR_STARTS = 100_000


@dataclass(frozen=True)
class NumberRange:
    """``length`` intervals [origin + n * period, origin + (n + 1) * period)."""

    origin: float
    period: float
    length: int

    def __post_init__(self):
        if not self.period > 0 or self.length < 0:
            raise EngineError(ErrorCode.DEFINITION, "a range needs a positive period and a length")

    def start(self, n: Column) -> Column:
        return F.lit(float(self.origin)) + n * F.lit(float(self.period))

    def raw(self, x: Column) -> Column:
        """Number of the interval, also beyond the length; null for what isn't a number or before the origin."""
        x = x.cast("double")
        n = F.floor((x - F.lit(float(self.origin))) / F.lit(float(self.period)))
        return F.when(~F.isnan(x) & (x >= self.origin) & (x < 9e18 * self.period), n.cast("long"))


@dataclass(frozen=True)
class DurationRange:
    """Intervals of a fixed duration from a moment on."""

    origin: dt.datetime
    period: dt.timedelta
    length: int

    def __post_init__(self):
        if self.period <= dt.timedelta(0) or self.length < 0:
            raise EngineError(ErrorCode.DEFINITION, "a range needs a positive period and a length")

    @property
    def micros(self) -> tuple[int, int]:
        origin = self.origin if self.origin.tzinfo else self.origin.replace(tzinfo=dt.timezone.utc)
        return (origin - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1), self.period // dt.timedelta(microseconds=1)

    def start(self, n: Column) -> Column:
        origin, period = self.micros
        return F.timestamp_micros(F.lit(origin) + n * F.lit(period))

    def raw(self, x: Column) -> Column:
        origin, period = self.micros
        at = F.unix_micros(x.cast("timestamp")) - F.lit(origin)
        return F.when(at >= 0, F.floor(at / F.lit(period)).cast("long"))


@dataclass(frozen=True)
class PeriodRange:
    """Calendar intervals: months and days are added again and again, so the end of a month, once met, stays."""

    origin: dt.date
    months: int
    days: int
    length: int

    def __post_init__(self):
        if self.months < 0 or self.days < 0 or self.months + self.days == 0 or self.length < 0:
            raise EngineError(ErrorCode.DEFINITION, "a range needs a positive period and a length")
        if self.length > MOST_CALENDAR_STARTS:
            raise EngineError(ErrorCode.DEFINITION, f"a calendar range has at most {MOST_CALENDAR_STARTS} intervals")

    def starts(self) -> list[dt.date]:
        """The starts and, last, the end of the range."""
        out, day = [], self.origin
        for _ in range(self.length + 1):
            out.append(day)
            y, m = divmod(day.year * 12 + day.month - 1 + self.months, 12)
            day = dt.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1])) + dt.timedelta(days=self.days)
        return out

    def start(self, n: Column) -> Column:
        return F.element_at(F.array(*(F.lit(d) for d in self.starts())), (n + 1).cast("int"))

    def raw(self, x: Column) -> Column:
        """Numbers beyond the length are given as the length."""
        x, starts = x.cast("date"), self.starts()
        if self.months == 0:
            n = F.floor(F.datediff(x, F.lit(self.origin)) / self.days)
        elif self.days == 0:
            # the interval of the month, or the one before if its start isn't reached yet
            by_month = F.floor((F.year(x) * 12 + F.month(x) - (self.origin.year * 12 + self.origin.month)) / self.months)
            held = F.least(F.greatest(by_month, F.lit(0)), F.lit(self.length))
            n = F.when(by_month < 0, -1).otherwise(held - F.when(x < F.element_at(F.array(*(F.lit(d) for d in starts)), (held + 1).cast("int")), 1).otherwise(0))
        else:
            n = F.size(F.filter(F.array(*(F.lit(d) for d in starts)), lambda s: s <= x)) - 1
        return F.when(n >= 0, F.least(n, F.lit(self.length)).cast("long"))


Range = NumberRange | DurationRange | PeriodRange


def range_table(spark: SparkSession, r: Range) -> DataFrame:
    """``(_id, value, interval)`` of all intervals; the id is the number of the interval."""
    n = spark.range(r.length).select(F.col("id").alias("interval"))
    return n.select(F.col("interval").alias(ID), r.start(F.col("interval")).alias("value"), "interval")


def interval_link(x: Column, r: Range) -> Column:
    """Id of the interval of ``x`` in the whole range table, -1 outside."""
    n = r.raw(x)
    return F.when(n < r.length, n).otherwise(F.lit(-1)).cast("long")


def project_range(facts: DataFrame, value: Column, r: Range, name: str, order: str = ID) -> tuple[DataFrame, DataFrame]:
    """The range table that the facts need, and the facts with their link ``name`` to it.

    The table begins with the interval of the first fact (in the order of ids)
    that lies in the range and reaches, without gaps, to the last interval
    needed; a fact beyond the range fills it to its end.  Facts before the first
    interval, outside the range, null or NaN are linked to -1 and add nothing.
    """
    seen = facts.withColumn("__n", r.raw(value))
    edge = seen.agg(
        F.min_by("__n", F.when(F.col("__n") < r.length, F.col(order))).alias("first"), F.max("__n").alias("most")
    ).select("first", F.least("most", F.lit(r.length - 1)).alias("last"))
    edge = edge.filter("first is not null")
    table = edge.select(F.explode(F.sequence("first", "last")).alias("interval"), "first")
    table = table.select((F.col("interval") - F.col("first")).alias(ID), r.start(F.col("interval")).alias("value"), "interval")
    first = edge.select("first").scalar()
    at = F.col("__n") - first
    linked = seen.withColumn(name, F.when((F.col("__n") < r.length) & (at >= 0), at).otherwise(F.lit(-1)).cast("long"))
    return table, linked.drop("__n")
