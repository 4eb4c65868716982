"""References to records that do not exist, are deleted, or arrive later.

Parent and child keys are put in one long form, tagged, and grouped by parent
table and key; child keys are pre-aggregated before that, so a hot key costs one
row per input split.  A group tells whether the key exists and whether any of
its references can be late or deleted at all; only the rows of such *suspect*
keys are looked at one by one.  The suspects are written down first: where they
are few, they go to the rows, which then aren't shuffled at all; where they are
many, rows and suspects meet by key, hot keys in slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise

#: Suspect keys up to this many go to the rows (about 100 bytes each); beyond, rows and keys are shuffled.
MOST_SENT = 200_000
#: References to a suspect key that make one slice of it when rows are shuffled.
ROWS_PER_SLICE = 1_000_000
#: A key with one in so many of all references is hot, so there are at most so many hot keys.
HOT_SHARE = 1_000


@dataclass(frozen=True)
class ParentTable:
    """A referenced table; ``loaded_at`` and ``deleted_at`` may be None (always there, never deleted)."""

    name: str
    df: DataFrame
    key: str
    loaded_at: str | None = None
    deleted_at: str | None = None


@dataclass(frozen=True)
class Reference:
    """A referring table.  ``seen_at`` is held against the parent's loading, ``event_at`` against its deletion."""

    src_table: str
    df: DataFrame
    row_id: str
    key: str
    parent: str
    seen_at: str | None = None
    event_at: str | None = None


def _ts(df: DataFrame, name: str | None) -> Column:
    return F.lit(None).cast("timestamp_ntz") if name is None else F.col(f"`{name}`").cast("timestamp_ntz")


def _child(r: Reference) -> DataFrame:
    """The referring rows in long form; null references refer to nothing and are left out."""
    return r.df.select(
        F.lit(r.parent).alias("parent"),
        F.col(f"`{r.key}`").cast("string").alias("k"),
        F.lit(r.src_table).alias("src_table"),
        F.col(f"`{r.row_id}`").cast("long").alias("row_id"),
        _ts(r.df, r.seen_at).alias("seen_at"),
        _ts(r.df, r.event_at).alias("event_at"),
    ).filter(F.col("k").isNotNull())


def _parent(p: ParentTable) -> DataFrame:
    return p.df.select(
        F.lit(p.name).alias("parent"),
        F.col(f"`{p.key}`").cast("string").alias("k"),
        _ts(p.df, p.loaded_at).alias("loaded_at"),
        _ts(p.df, p.deleted_at).alias("deleted_at"),
    ).filter(F.col("k").isNotNull())


def key_status(parents: list[ParentTable], references: list[Reference]) -> DataFrame:
    """One row per (parent table, referenced key): is there a parent, and the spans of both sides.

    A key stored several times in the parent table counts as loaded at its first
    loading and as deleted only if all its rows are, at the last deletion.
    """
    tagged = None
    for p in parents:
        own = _parent(p).select(
            "parent", "k", F.lit(1).alias("is_parent"), F.lit(0).cast("long").alias("n_refs"), "loaded_at", "deleted_at",
            F.when(F.col("deleted_at").isNull(), 1).otherwise(0).alias("alive"),
            F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(None).cast("timestamp_ntz").alias("last_event"),
        )
        tagged = own if tagged is None else tagged.unionByName(own)
    for r in references:
        own = _child(r).groupBy("parent", "k").agg(
            F.count(F.lit(1)).alias("n_refs"), F.min("seen_at").alias("first_seen"), F.max("event_at").alias("last_event")
        )
        own = own.select(
            "parent", "k", F.lit(0).alias("is_parent"), "n_refs", F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(0).alias("alive"), "first_seen", "last_event",
        )
        tagged = tagged.unionByName(own)
    return tagged.groupBy("parent", "k").agg(
        F.max("is_parent").alias("is_parent"), F.sum("n_refs").alias("n_refs"), F.min("loaded_at").alias("loaded_at"),
        F.when(F.max("alive") == 0, F.max("deleted_at")).alias("deleted_at"),
        F.min("first_seen").alias("first_seen"), F.max("last_event").alias("last_event"),
    ).filter(F.col("n_refs") > 0)


def orphan_rows(parents: list[ParentTable], references: list[Reference], most_sent: int = MOST_SENT, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Every distinct ``(src_table, row_id, kind, period)`` whose reference leads to no live parent row.

    ``kind`` is ``missing`` if the key is in no parent row, else ``late`` if the
    parent was loaded after the row, else ``deleted`` if the parent was deleted
    at or before the row's event.  ``period`` is the month of the row's event
    (of its loading where it has none).  Null references are no references;
    null times are never late or deleted; copies of a row come out once; empty
    tables give an empty result, an empty parent table makes every reference
    missing.
    """
    status = key_status(parents, references)
    suspects = status.filter(
        (F.col("is_parent") == 0) | (F.col("first_seen") < F.col("loaded_at")) | (F.col("last_event") >= F.col("deleted_at"))
    ).select("parent", "k", "is_parent", "n_refs", "loaded_at", "deleted_at")
    suspects = materialise(suspects, "suspects")
    rows = None
    for r in references:
        own = _child(r)
        rows = own if rows is None else rows.unionByName(own)
    if suspects.count() <= most_sent:
        met = rows.join(F.broadcast(suspects), ["parent", "k"])
    else:
        met = _by_slices(rows, suspects, rows_per_slice)
    kind = (
        F.when(F.col("is_parent") == 0, "missing")
        .when(F.col("loaded_at") > F.col("seen_at"), "late")
        .when(F.col("deleted_at") <= F.col("event_at"), "deleted")
    )
    period = F.date_format(F.coalesce("event_at", "seen_at"), "yyyy-MM")
    return (
        met.select("src_table", "row_id", kind.alias("kind"), period.alias("period"), F.col("k").alias("key"))
        .filter(F.col("kind").isNotNull())
        .dropDuplicates(["src_table", "row_id", "kind", "period", "key"])
    )


def _by_slices(rows: DataFrame, suspects: DataFrame, rows_per_slice: int) -> DataFrame:
    """The rows of suspect keys with the keys' status; a hot key is cut into as many slices as its references ask for."""
    slices = F.ceil(F.col("n_refs") / rows_per_slice).cast("int")
    total = suspects.agg(F.sum("n_refs")).first()[0] or 0
    # no more than HOT_SHARE keys can hold one in HOT_SHARE of the references each
    hot = suspects.filter((F.col("n_refs") * HOT_SHARE >= total) & (slices > 1)).select("parent", "k", slices.alias("slices"))
    spread = rows.join(F.broadcast(hot), ["parent", "k"], "left")
    spread = spread.withColumn("slice", F.when(F.col("slices") > 1, F.pmod(F.xxhash64("row_id", "seen_at", "event_at", F.spark_partition_id()), F.col("slices")).cast("int")).otherwise(0)).drop("slices")
    per_key = suspects.withColumn("slices", F.when((F.col("n_refs") * HOT_SHARE >= total) & (slices > 1), slices).otherwise(1))
    cut = per_key.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "n_refs")
    return spread.join(cut, ["parent", "k", "slice"])


def missing_by_period(parents: list[ParentTable], references: list[Reference]) -> DataFrame:
    """Stored rows and distinct keys without any parent row, per referring table and month.

    This is the long form alone: references are counted per (parent, key, source,
    month), grouped with the parent keys, and the groups without a parent are
    summed by month.  No row-level join takes place.
    """
    tagged = None
    for p in parents:
        own = _parent(p).select("parent", "k", F.lit(1).alias("is_parent"), F.lit(None).cast("struct<src_table:string,period:string,n:bigint>").alias("c"))
        tagged = own if tagged is None else tagged.unionByName(own)
    for r in references:
        own = _child(r).withColumn("period", F.date_format(F.coalesce("event_at", "seen_at"), "yyyy-MM"))
        own = own.groupBy("parent", "k", "src_table", "period").agg(F.count(F.lit(1)).alias("n"))
        tagged = tagged.unionByName(own.select("parent", "k", F.lit(0).alias("is_parent"), F.struct("src_table", "period", "n").alias("c")))
    # a group holds one entry per source and month at most
    groups = tagged.groupBy("parent", "k").agg(F.max("is_parent").alias("is_parent"), F.collect_list("c").alias("cs")).filter("is_parent = 0")
    return (
        groups.select("k", F.inline("cs"))
        .groupBy("src_table", "period")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    )


def orphans_by_period(parents: list[ParentTable], references: list[Reference]) -> DataFrame:
    """Orphan rows and distinct keys per referring table, month and kind."""
    return orphan_rows(parents, references).groupBy("src_table", "period", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("key").alias("n_keys")
    )
