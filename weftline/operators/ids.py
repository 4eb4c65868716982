"""Dense row ids without sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise

ID = "_id"
#: monotonically_increasing_id holds the number of a partition above this many bits of the row's place in it.
_PLACE_BITS = 33


def _numbered(df: DataFrame, name: str, start: int | Column) -> DataFrame:
    """Dense ids in the order of the partitions of ``df`` and of the rows in them.

    The table is written down once with each row's partition and place, so a task
    that runs again cannot number rows otherwise; what comes to the driver is one
    number per partition written.
    """
    spark = df.sparkSession
    placed = materialise(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACE_BITS)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    shifts, before = [], 0
    for p, n in sizes:
        shifts.append((p, before - (p << _PLACE_BITS)))
        before += n
    if len(shifts) <= 1:
        return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__at") + F.lit(shifts[0][1] if shifts else 0) + start).cast("long").alias(name))
    offsets = F.broadcast(spark.createDataFrame(shifts, "__part long, __shift long"))  # as many rows as there were tasks
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__at") + F.col("__shift") + start).cast("long").alias(name))


def with_ids(df: DataFrame, order_by: list[str], name: str = ID, start: int | Column = 0, unique: bool = False) -> DataFrame:
    """``df`` with dense ids ``start``, ``start + 1``, ... in the order of ``order_by``.

    Rows are partitioned by ranges of the order columns and sorted within each;
    ids are the place in a partition plus the sizes of the partitions before.
    The same happens at every size; how many ranges there are is left to the
    session's shuffle partitions and adaptive execution.  Rows that tie in all
    order columns may get their ids in any order, and ties are spread by a hash
    of the row unless the order is known to be ``unique``; nulls come first.  An
    empty table stays empty; a column ``name`` of ``df`` is replaced.
    """
    df = df.drop(name)
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    kept, ranged = df.columns, df
    if not unique and (rest := [f.name for f in df.schema.fields if f.name not in order_by and "map<" not in f.dataType.simpleString()]):
        ranged = df.withColumn("__tie", F.xxhash64(*(F.col(f"`{c}`") for c in rest)))
        order.append(F.col("__tie").asc())
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    return _numbered(ranged.select(*(F.col(f"`{c}`") for c in kept)), name, start)


def arrival_ids(df: DataFrame, name: str = ID, start: int | Column = 0) -> DataFrame:
    """``df`` with dense ids in the order in which its source yields the rows; nothing is shuffled or sorted."""
    return _numbered(df.drop(name), name, start)


def arrival_order(df: DataFrame, name: str = "__arrival") -> DataFrame:
    """A column that grows in the order in which a source yields its rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def is_dense(df: DataFrame, name: str = ID) -> bool:
    """Whether the ids of a table have no gaps."""
    n, low, high = df.agg(F.count(name), F.min(name), F.max(name)).first()
    return n == 0 or high - low + 1 == n


def nth_id(df: DataFrame, n: int, name: str = ID, cuts: int = 4096) -> int | None:
    """The id with ``n`` lower ones, None if there are no more than ``n``; ids may have gaps.

    The span of ids is cut into pieces whose rows are counted, then the piece
    that holds the id, and so on: a few passes over the ids, of which no more than
    ``cuts`` counts come to the driver.
    """
    low, high, total = df.agg(F.min(name), F.max(name), F.count(name)).first()
    if n >= total:
        return None
    while low < high:
        width = -(-(high - low + 1) // cuts)
        piece = F.floor((F.col(name) - F.lit(low)) / F.lit(width)).cast("long")
        counts = df.filter(F.col(name).between(low, high)).groupBy(piece.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        for k, m in sorted((r[0], r[1]) for r in counts):
            if n < m:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            n -= m
    return low
