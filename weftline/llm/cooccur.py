"""Items that appear together: pair counts by stripes, with log-likelihood ratios.

Every task turns its baskets into stripes (item -> neighbours with counts),
combined over all baskets of the block; stripes of one item meet by its key and
their entries are summed.  Pairs that cannot pass the thresholds are left out
early, but only where that is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise, ship_package

#: A hot item's stripe is cut into so many parts, so that no task gets it whole.
PARTS = 32
#: Items in at least one of so many baskets are hot.
HOT_SHARE = 1000
#: Pairs held at once by a task before they are combined, and items per side of a block of a long basket.
BLOCK_PAIRS, BLOCK_ITEMS = 1 << 19, 1024


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """``(items)``: the sorted distinct items of every basket; rows without basket or item are left out."""
    return (
        df.select(F.col(f"`{basket}`").alias("b"), F.col(f"`{item}`").cast("long").alias("i"))
        .filter("b is not null and i is not null")
        .groupBy("b")
        .agg(F.sort_array(F.collect_set("i")).alias("items"))
        .select("items")
    )


def item_counts(sets: DataFrame) -> DataFrame:
    """``(item, c)``: in how many baskets every item is."""
    return sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))


def pair_blocks(lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b within each list, in chunks of about BLOCK_PAIRS; lists of one length are done at once."""
    by_len: dict[int, list[np.ndarray]] = {}
    for x in lists:
        by_len.setdefault(len(x), []).append(x)
    for n, xs in by_len.items():
        if n < 2:
            continue
        if n <= 256:
            left, right = np.triu_indices(n, 1)
            step = max(1, BLOCK_PAIRS // len(left))
            for k in range(0, len(xs), step):
                m = np.stack(xs[k : k + step])
                yield m[:, left].ravel(), m[:, right].ravel()
            continue
        for x in xs:
            for i in range(0, n, BLOCK_ITEMS):
                for j in range(i, n, BLOCK_ITEMS):
                    a, b = x[i : i + BLOCK_ITEMS], x[j : j + BLOCK_ITEMS]
                    if i == j:
                        left, right = np.triu_indices(len(a), 1)
                        yield a[left], a[right]
                    else:
                        yield np.repeat(a, len(b)), np.tile(b, len(a))


class Stripes:
    """Counts of pairs, combined whenever many are waiting."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.kept = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b, np.ones(len(a), np.int64)))
        self.size += len(a)
        if self.size - self.kept > 2 * BLOCK_PAIRS:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.waiting:
            return (np.empty(0, np.int64),) * 3
        a, b, n = (np.concatenate(x) for x in zip(*self.waiting))
        names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        key = codes[: len(a)].astype(np.int64) * len(names) + codes[len(a) :]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(n[order], first) if len(first) else n
        a, b = names[key[first] // len(names)], names[key[first] % len(names)]
        self.waiting, self.size, self.kept = [(a, b, n)], len(a), len(a)
        return a, b, n


def _pieces(long: DataFrame) -> DataFrame:
    """``(items, others)``: pairs of pieces of long baskets, spread over tasks; null ``others`` stand for the piece itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                x = x.values
                ps = [x.slice(i, BLOCK_ITEMS) for i in range(0, len(x), BLOCK_ITEMS)]
                for i, p in enumerate(ps):  # one piece with all that come after it, some at a time
                    for k in range(i, len(ps), 64):
                        others = [q.to_numpy(zero_copy_only=False) if j > i else None for j, q in enumerate(ps[k : k + 64], k)]
                        yield pa.RecordBatch.from_arrays([pa.array([p.to_numpy(zero_copy_only=False)] * len(others), pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))], names=["items", "others"])

    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return long.mapInArrow(cut, "items array<long>, others array<long>").repartition(parts)


def pair_counts(sets: DataFrame, dropped: np.ndarray, hot: np.ndarray) -> DataFrame:
    """``(a, b, k)`` with a < b for all pairs of items that are not in ``dropped``.

    Both arrays are short by proof: an item in one of m baskets takes one m-th
    of all basket places, so there are at most m times the mean basket of them.
    """

    def lists(col: pa.Array) -> list[np.ndarray]:
        """The items of every row, without the dropped ones."""
        return [x[~np.isin(x, dropped)] if len(dropped) else x for x in (r.values.to_numpy(zero_copy_only=False) for r in col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            col = batch.column(0)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
            if len(dropped):
                keep = ~np.isin(flat, dropped)
                ends = np.cumsum(keep)[ends - 1] if len(flat) else ends
                flat = flat[keep]
            starts = np.r_[0, ends[:-1]]
            for a, b in pair_blocks([flat[i:j] for i, j in zip(starts, ends) if j - i > 1]):
                stripes.add(a, b)
            if stripes.size > 4 * BLOCK_PAIRS:
                yield from emit(stripes)
        yield from emit(stripes)

    def run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            for x, y in zip(lists(batch.column(0)), batch.column(1)):
                if y.is_valid:
                    (y,) = lists([y])
                    stripes.add(np.repeat(x, len(y)), np.tile(y, len(x)))
                else:
                    left, right = np.triu_indices(len(x), 1)
                    stripes.add(x[left], x[right])
                if stripes.size > 4 * BLOCK_PAIRS:
                    yield from emit(stripes)
        yield from emit(stripes)

    def emit(stripes: Stripes) -> Iterator[pa.RecordBatch]:
        a, b, n = stripes.combine()
        stripes.waiting, stripes.size, stripes.kept = [], 0, 0
        if not len(a):
            return
        part = np.where(np.isin(a, hot), b % PARTS, 0)
        order = np.lexsort((part, a))
        a, b, n, part = a[order], b[order], n[order], part[order]
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
        offsets = pa.array(np.r_[cut, len(a)].astype(np.int32))
        arrays = [pa.array(a[cut]), pa.array(part[cut].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))]
        whole = pa.RecordBatch.from_arrays(arrays, names=["a", "part", "bs", "ks"])
        for k in range(0, whole.num_rows, 20_000):
            yield whole.slice(k, 20_000)

    kind = "a long, part int, bs array<long>, ks array<int>"
    stripes = sets.filter((F.size("items") > 1) & (F.size("items") <= BLOCK_ITEMS)).mapInArrow(run, kind)
    stripes = stripes.unionByName(_pieces(sets.filter(F.size("items") > BLOCK_ITEMS)).mapInArrow(run_pieces, kind))
    # the exchange carries whole stripes; what follows is summed within it, without another one
    merged = stripes.repartition("a", "part").select("a", "part", F.explode(F.arrays_zip("bs", "ks")).alias("e"))
    return merged.groupBy("a", "part", F.col("e.bs").alias("b")).agg(F.sum(F.col("e.ks").cast("long")).alias("k")).select("a", "b", "k")


def log_likelihood_ratio(k: Column, ca: Column, cb: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table of baskets with and without each item."""

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))

    k, ca, cb, n = (c.cast("double") for c in (k, ca, cb, n))
    cells = term(k) + term(ca - k) + term(cb - k) + term(n - ca - cb + k)
    return F.greatest(F.lit(0.0), 2 * (cells + term(n) - term(ca) - term(n - ca) - term(cb) - term(n - cb)))


def cooccurrence(df: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float | None = None) -> DataFrame:
    """``(item_a, item_b, k, c_a, c_b, n, lift, llr)``, item_a < item_b, of pairs that meet in ``min_count`` baskets or more.

    ``k`` is the number of distinct baskets with both, ``c_*`` with one of them,
    ``n`` all baskets; ``lift`` is k*n/(c_a*c_b).  Rows with a null basket or item
    don't count, an item several times in a basket counts once, copies of rows
    change nothing, an empty table gives an empty result.  With ``min_lift``,
    items in more than n/min_lift baskets are dropped before pairs are built,
    as k <= min(c_a, c_b) keeps their lift below it.
    """
    ship_package(df.sparkSession)
    sets = materialise(baskets(df, basket, item), "baskets")  # used three times
    counts = item_counts(sets)
    n = sets.count()
    often = counts.filter(F.col("c") * HOT_SHARE >= n).collect() if n else []
    hot = np.array(sorted(r["item"] for r in often), np.int64)
    dropped = np.array(sorted(r["item"] for r in often if min_lift and r["c"] * min_lift > n), np.int64)
    pairs = pair_counts(sets, dropped, hot).filter(F.col("k") >= min_count)
    ca, cb = counts.select(F.col("item").alias("a"), F.col("c").alias("ca")), counts.select(F.col("item").alias("b"), F.col("c").alias("cb"))
    got = pairs.join(ca, "a").join(cb, "b")
    total = F.lit(n).cast("long")
    lift = F.col("k") * total / (F.col("ca") * F.col("cb"))
    if min_lift is not None:
        got = got.filter(F.col("k").cast("decimal(38,0)") * total >= F.lit(min_lift) * F.col("ca").cast("decimal(38,0)") * F.col("cb") if isinstance(min_lift, int) else lift >= min_lift)
    return got.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "k", F.col("ca").alias("c_a"), F.col("cb").alias("c_b"), total.alias("n"),
        lift.alias("lift"), log_likelihood_ratio(F.col("k"), F.col("ca"), F.col("cb"), total).alias("llr"),
    )
