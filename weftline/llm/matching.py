"""Matching records of two tables that share no key, with a confidence.

Names are cut into words.  Words that may be there or not are learned first: names
that differ by nothing else have like prices.  Without them, a record of the left
table leads with its brand word; in the right table any word may be the brand.
Words that don't occur on the other side are linked to similar ones by MinHash
over their letter pairs.  Records are compared if their brand words are linked and
they share one other word or more; where a brand and a word are so common that one
task would have too many pairs, these are cut into slices.  Where names of one
brand and like prices differ again and again by the same words, these are taken
for another wording of one thing.  A
logistic model over similarities of names and categories, trained on the weak
labels that prices give and calibrated on others, rates the pairs together with
their prices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.units import NUMBER_WORDS
from weftline.session import materialise, ship_package

#: Words: bands over letter pairs; chance meetings per word that the rows of a band may leave (two words share about
#: a tenth of their letter pairs by chance); least similarity of linked words.
WORD_BANDS, CHANCE_MEETINGS, LEAST_SIMILAR = 32, 500, 0.6
#: A block of this many pairs or more is compared in slices of about so many.
HEAVY_BLOCK = 1_000_000
#: Another wording needs so many pairs of like prices (their logarithms differ by no more than this), and this share of all pairs that differ by the same words.
WORDING_PAIRS, LIKE_PRICE, WORDING_SHARE = 3, 0.08, 0.5
#: Pairs on which the model is fitted and calibrated, at most about so many.
SAMPLE = 20_000

ACCENTS = ("áàâäãåéèêëíìîïóòôöõøúùûüñçý", "aaaaaaeeeeiiiioooooouuuuncy")
#: What the classifier looks at: names and categories. Prices are the weak labels it learns from, and further evidence beside it.
FEATURES = ("brand", "cover", "mean", "extra", "category", "no_category", "grade")
#: What the weights (bias first) are taken to be before any pair is seen.
PRIOR_WEIGHTS = (-14.0, 8.0, 6.0, 2.0, -3.0, 0.0, 0.0, 0.0)
#: How strongly the weights are held to these, and the calibration to none: as much as so many pairs.
RIDGE, LINE_RIDGE = 1.0, 10.0
#: Bounds of the classes of price differences (of logarithms), and how pairs of one thing and of two are spread over them before any is seen.
GAPS = (0.02, 0.05, 0.08, 0.15, 0.3, 0.7)
PRIOR_SAME, PRIOR_OTHER = (0.35, 0.35, 0.15, 0.07, 0.04, 0.02, 0.02), (0.03, 0.04, 0.04, 0.09, 0.18, 0.3, 0.32)


@dataclass(frozen=True)
class Side:
    """Columns of one table: id, name, price in a unit common to both sides, category."""

    df: DataFrame
    row_id: str
    name: str
    price: str | None = None
    category: str | None = None


def shuffled(df: DataFrame) -> DataFrame:
    """For joins of what grows with the tables: never broadcast, as that passes through the driver.

    The optimizer's sizes don't keep it from that: what explode and Python
    functions put out is many times as large as it takes it to be.
    """
    return df.hint("merge")


def name_words(name: Column) -> Column:
    """Words of a name in order, in lower case without accents; a final dot marks an abbreviation. A pack after a comma (it has a number) is no part of the name."""
    plain = F.translate(F.lower(name), *ACCENTS)
    plain = F.regexp_replace(plain, rf",[^,]*(?:[0-9½¼¾]|\b(?:{'|'.join((*NUMBER_WORDS, 'dozen'))})\b).*$", "")
    plain = F.regexp_replace(plain, r"['’]s\b", " ")
    return F.regexp_extract_all(plain, F.lit(r"([a-z]+[.]?)"), 1)


def records(side: Side) -> DataFrame:
    """``(rec, name, words, price, category)``: the different records of a table; equal ones are one."""
    d = side.df.select(
        F.col(f"`{side.name}`").cast("string").alias("name"),
        (F.col(f"`{side.price}`") if side.price else F.lit(None)).cast("double").alias("price"),
        (F.col(f"`{side.category}`") if side.category else F.lit(None)).cast("string").alias("category"),
    )
    d = d.withColumn("price", F.when((F.col("price") > 0) & (F.col("price") < 1e15), F.col("price")))
    return d.select(record_id().alias("rec"), "name", "price", "category").filter("name is not null").distinct().withColumn("words", name_words(F.col("name")))


#: Quantiles of the prices of left rows with one name; a right price is held against the nearest.
PRICE_POINTS = [k / 20 for k in range(21)]


def left_rows(side: Side) -> DataFrame:
    """``(id, words, price, category)`` of every left row with an id and a name."""
    d = side.df.select(
        F.col(f"`{side.row_id}`").cast("long").alias("id"), name_words(F.col(f"`{side.name}`").cast("string")).alias("words"),
        (F.col(f"`{side.price}`") if side.price else F.lit(None)).cast("double").alias("price"),
        (F.col(f"`{side.category}`") if side.category else F.lit(None)).cast("string").alias("category"),
    ).filter("id is not null and words is not null")
    return d.withColumn("price", F.when((F.col("price") > 0) & (F.col("price") < 1e15), F.col("price")))


def leading_records(side: Side) -> DataFrame:
    """``(rec, words, prices, category)`` of the left table: one per different name, whose ``rec`` is the lowest id of its rows.

    Prices are those of all rows of the name (their quantiles, where there are
    many), the category is the most frequent one.  However many rows share a
    name, a right record meets it once.
    """
    prices = F.array_distinct(F.percentile_approx("price", PRICE_POINTS, 1000)).alias("prices")
    return left_rows(side).groupBy("words").agg(F.min("id").alias("rec"), prices, F.mode("category", True).alias("category")).select("rec", "words", "prices", "category")


def left_members(side: Side) -> DataFrame:
    """``(left_id, same_as)``: every left row with the id that stands for all rows of its name."""
    rows = left_rows(side).select("id", "words")
    first = rows.groupBy("words").agg(F.min("id").alias("same_as"))
    return rows.join(first, "words").select(F.col("id").alias("left_id"), "same_as").distinct()


def learn_optional(left: DataFrame, right: DataFrame) -> set[str]:
    """Words that names of one thing may have or lack, of all names of both tables.

    A name without one of its words, or without two neighbouring ones, may be
    another name.  Where taking certain words away leads to names of like price
    in half of the cases or more (and three or more), these words are optional.
    Names meet by equality, and every name is there once, so there are no more
    meetings than words.  Only words that reach the minimum come to the driver.
    """
    names = left.select("words", F.get("prices", (F.size("prices") / 2).cast("int")).alias("price")).unionByName(right.select("words", "price"))
    names = names.filter("price is not null").groupBy(F.sort_array(F.array_distinct("words")).alias("set")).agg(F.min("words").alias("words"), F.percentile_approx("price", 0.5, 1000).alias("price"))
    places = F.sequence(F.lit(0), F.size("words") - 1)
    gone = F.flatten(F.transform(places, lambda i: F.array(F.slice("words", i + 1, F.lit(1)), F.slice("words", i + 1, F.lit(2)))))
    less = names.filter(F.size("words") > 1).select("set", "price", F.explode(F.array_distinct(F.transform(gone, lambda g: F.sort_array(F.array_distinct(g))))).alias("gone"))
    less = less.select(F.array_except("set", "gone").alias("set"), "gone", F.col("price").alias("dearer"))
    met = less.join(shuffled(names.select("set", "price")), "set")
    by = met.groupBy("gone").agg(F.sum((F.abs(F.ln(F.col("dearer") / F.col("price"))) <= LIKE_PRICE).cast("long")).alias("like"), F.count(F.lit(1)).alias("n"))
    by = by.filter((F.col("like") >= WORDING_PAIRS) & (F.col("like") >= WORDING_SHARE * F.col("n")))
    return {r[0] for r in by.select(F.explode("gone").alias("w")).distinct().collect()}


def record_id() -> Column:
    return F.xxhash64(F.col("name"), F.coalesce(F.col("price"), F.lit(-1.0)), F.coalesce(F.col("category"), F.lit("\u0000")))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal words, 0.95 for an abbreviation of the other, else by edits; ``b`` may end in a dot."""
    bare = F.regexp_replace(b, "[.]", "")
    short = F.endswith(b, F.lit(".")) & F.startswith(a, bare) & (F.length(bare) >= 2)
    return F.when(a == bare, 1.0).when(short, 0.95).otherwise(1 - F.levenshtein(a, bare) / F.greatest(F.length(a), F.length(bare)))


def band_shape(vocabulary: int) -> tuple[int, int]:
    """Bands and their rows: as a vocabulary grows, rows keep the chance meetings of a word at bay, and more bands keep words that share 0.4 of their letter pairs meeting."""
    rows = max(2, math.ceil(math.log10(max(1, vocabulary) * WORD_BANDS / CHANCE_MEETINGS)))
    return math.ceil(WORD_BANDS * (1 / 0.4) ** (rows - 2)), rows


def word_keys(words: list[str], bands: int, rows: int) -> np.ndarray:
    """(word, band) keys: MinHashes over letter pairs (with the ends marked), ``rows`` of them per band."""
    if not words:
        return np.empty((0, bands), np.int64)
    letters = 28  # a to z, beginning, end
    rng = np.random.default_rng(17)
    table = rng.integers(0, 1 << 62, (bands * rows, letters * letters), np.int64)
    factor = rng.integers(1, 1 << 62, (bands, rows), np.int64) | 1
    plain = [w.replace(".", "") for w in words]
    size = np.array([len(w) + 1 for w in plain])
    text = np.frombuffer("".join("^" + w + "$" for w in plain).encode("ascii"), np.uint8).astype(np.int64)
    code = np.select([text == ord("^"), text == ord("$")], [26, 27], text - ord("a"))
    ends = np.cumsum(size + 1) - 1
    pairs = np.delete(code[:-1] * letters + code[1:], ends[:-1])
    starts = np.cumsum(size) - size
    out = np.empty((len(words), bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            mins = np.minimum.reduceat(table[b * rows : (b + 1) * rows][:, pairs], starts, axis=1)
            out[:, b] = (mins * factor[b][:, None]).sum(axis=0) + b
    return out


def banded(words: DataFrame, col: str, bands: int, rows: int) -> DataFrame:
    """``(col, key)``: the words under their keys; spread over the session's partitions, as hashing is dear."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column(0)
            for k in range(0, batch.num_rows, 2_000):
                some = ws.slice(k, 2_000)
                keys = word_keys(some.to_pylist(), bands, rows)
                yield pa.RecordBatch.from_arrays([some.take(pa.array(np.repeat(np.arange(len(some)), bands))), pa.array(keys.ravel())], names=[col, "key"])

    return words.select(col).repartition(parts).mapInArrow(run, f"{col} string, key long")


def link_words(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """``(given, wanted, sim)``: every given word with the wanted words equal or similar to it.

    Only words without an equal one are looked up by MinHash.  Words are
    distinct on both sides, so no group is larger than a vocabulary.
    """
    bands, rows = band_shape(wanted.count())
    given = given.withColumn("bare", F.regexp_replace("given", "[.]", ""))
    equal = given.join(shuffled(wanted), F.col("bare") == F.col("wanted")).select("given", "wanted", F.lit(1.0).alias("sim"))
    odd = given.join(shuffled(wanted), F.col("bare") == F.col("wanted"), "left_anti")
    near = banded(odd, "given", bands, rows).join(shuffled(banded(wanted, "wanted", bands, rows)), "key").select("given", "wanted").distinct()
    # an abbreviation shares its beginning, though perhaps few letter pairs: it meets the words that begin with all of it
    heads = F.sequence(F.lit(2), F.length("wanted"))
    begun = wanted.filter(F.length("wanted") >= 2).select("wanted", F.explode(F.transform(heads, lambda n: F.substring("wanted", F.lit(1), n))).alias("bare"))
    short = odd.filter(F.endswith("given", F.lit(".")) & (F.length("bare") >= 2)).join(shuffled(begun), "bare")
    near = near.unionByName(short.select("given", "wanted")).distinct().withColumn("sim", similarity(F.col("wanted"), F.col("given")))
    return equal.unionByName(near.filter(F.col("sim") >= LEAST_SIMILAR))


@dataclass
class Blocks:
    """What records meet by: left and right records under (brand, other word), written down."""

    left: DataFrame  # lrec, brand, word, n_rest
    right: DataFrame  # rrec, brand, word, n_rest
    known: DataFrame  # rrec, known: the words of right records that the left table uses as well
    heavy: DataFrame  # brand, word, lparts, rparts of the blocks that are compared in slices, and into how many parts each side falls


def blocks(left: DataFrame, right: DataFrame, optional: set[str], heavy_block: int = HEAVY_BLOCK) -> Blocks:
    """Records under their brand and every other word; a name that is a brand alone has the other word ""."""
    opt = F.array(*(F.lit(w) for w in (*sorted(optional), ""))).cast("array<string>")
    core = F.filter("words", lambda w: ~F.array_contains(opt, w))
    left = left.select(F.col("rec").alias("lrec"), core.alias("core")).filter(F.size("core") > 0)
    left = left.select("lrec", F.get("core", F.lit(0)).alias("brand"), F.array_distinct(F.slice("core", F.lit(2), F.size("core"))).alias("rest"))
    right = right.select(F.col("rec").alias("rrec"), F.array_distinct(core).alias("core"))
    given = right.select(F.explode("core").alias("given")).distinct()
    brands = materialise(link_words(left.select(F.regexp_replace("brand", "[.]", "").alias("wanted")).distinct(), given), "brands")
    others = materialise(link_words(left.select(F.explode("rest").alias("wanted")).select(F.regexp_replace("wanted", "[.]", "").alias("wanted")).distinct(), given), "words")
    said = right.select("rrec", F.explode("core").alias("given"))
    # the other words of a right record, in the left table's spelling; the word taken for the brand is left out
    spoken = said.join(shuffled(others), "given").select("rrec", F.struct("given", "wanted").alias("w")).groupBy("rrec").agg(F.collect_set("w").alias("ws"))
    heads = said.join(shuffled(brands), "given").select("rrec", "given", F.col("wanted").alias("brand")).join(shuffled(spoken), "rrec", "left").join(shuffled(right.select("rrec", F.size("core").alias("n"))), "rrec")
    rest = F.transform(F.filter(F.coalesce("ws", F.array()), lambda w: w["given"] != F.col("given")), lambda w: w["wanted"])
    heads = heads.select("rrec", "brand", F.array_distinct(rest).alias("rest"), (F.col("n") - 1).alias("n_rest"))
    bare = F.regexp_replace("brand", "[.]", "").alias("brand")
    alone = F.when(F.col("n_rest") == 0, F.array(F.lit(""))).otherwise(F.col("rest"))
    lkeys = left.withColumn("n_rest", F.size("rest")).select("lrec", bare, F.explode(alone).alias("word"), "n_rest").withColumn("word", F.regexp_replace("word", "[.]", ""))
    lkeys, rkeys = materialise(lkeys, "left"), materialise(heads.select("rrec", "brand", F.explode(alone).alias("word"), "n_rest"), "right")
    sizes = lkeys.groupBy("brand", "word").agg(F.count(F.lit(1)).alias("m")).join(shuffled(rkeys.groupBy("brand", "word").agg(F.count(F.lit(1)).alias("n"))), ["brand", "word"])
    parts = [F.ceil(F.col(c) / max(1, math.isqrt(heavy_block))).cast("int").alias(p) for c, p in (("m", "lparts"), ("n", "rparts"))]
    heavy = materialise(sizes.filter(F.col("m") * F.col("n") >= heavy_block).select("brand", "word", *parts), "heavy")
    equal = brands.filter("sim = 1").select("given").unionByName(others.filter("sim = 1").select("given")).distinct()
    known = said.join(shuffled(equal), "given").groupBy("rrec").agg(F.collect_set("given").alias("known"))
    return Blocks(lkeys, rkeys, known, heavy)


def candidates(b: Blocks) -> DataFrame:
    """``(lrec, rrec)``: pairs of records whose brands are linked and that share another word, heavy blocks aside."""
    left = b.left.join(b.heavy, ["brand", "word"], "left_anti")
    return left.join(shuffled(b.right), ["brand", "word"]).select("lrec", "rrec").distinct()


def heavy_pairs(b: Blocks) -> DataFrame:
    """``(lrec, rrec)``: all pairs of heavy blocks. Every part of one side meets every part of the other in a slice of its own."""
    keys, n = ["brand", "word", "lpart", "rpart"], int(b.left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(rec: str, part: str, of: str) -> Column:
        return F.pmod(F.xxhash64(rec), F.col(of)).cast("int").alias(part)

    def every(part: str, of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(part)

    left = b.left.join(b.heavy, ["brand", "word"]).select("lrec", "brand", "word", parts("lrec", "lpart", "lparts"), every("rpart", "rparts"))
    right = b.right.join(b.heavy, ["brand", "word"]).select("rrec", "brand", "word", every("lpart", "lparts"), parts("rrec", "rpart", "rparts"))
    # a number of partitions that is asked for stays: the rows are few, the pairs they make are not
    return left.repartition(n, *keys).join(shuffled(right.repartition(n, *keys)), keys).select("lrec", "rrec")


def all_candidates(b: Blocks) -> DataFrame:
    """``(lrec, rrec)``: all pairs of records whose brands are linked and that share another word, however common it is."""
    return candidates(b).unionByName(heavy_pairs(b)).distinct() if b.heavy.count() else candidates(b)


def heavy_candidates(b: Blocks, wording: set[tuple[str, str]]) -> DataFrame:
    """The likeliest pairs of heavy blocks: those that share a second other word, or of which the left one has no second. No query rests on them; see ``heavy_pairs``.

    A learned wording counts as sharing: where a right record says its spare
    words, it stands under the lacking ones too.  Other pairs of such a block share
    one linked word, which can be enough for a match.
    """
    spark = b.left.sparkSession
    said = spark.createDataFrame([(s, x) for spare, lacking in sorted(wording) for s in spare.split()[:1] for x in lacking.split()], "said string, word string")
    right = b.right.unionByName(b.right.withColumnRenamed("word", "said").join(said, "said").select("rrec", "brand", "word", "n_rest")).distinct()

    def in_heavy(keys: DataFrame, rec: str) -> tuple[DataFrame, DataFrame]:
        """The records of heavy blocks, and heavy blocks of a record with each of its other words of the same brand."""
        hot = keys.join(b.heavy, ["brand", "word"]).select(rec, "brand", "word", "n_rest")
        more = hot.join(keys.select(rec, "brand", F.col("word").alias("second")), [rec, "brand"]).filter("second <> word")
        return hot.select(rec, "brand", "word", "n_rest"), more.select(rec, "brand", "word", "second")

    l, l2 = in_heavy(b.left, "lrec")
    r, r2 = in_heavy(right, "rrec")
    two = l2.join(r2, ["brand", "word", "second"]).select("lrec", "rrec")
    # different names of one word are few, as names are different: one per brand and word
    one = l.filter("n_rest <= 1").join(r, ["brand", "word"]).select("lrec", "rrec")
    return two.unionByName(one).distinct()


def word_similarity(a: str, b: str) -> float:
    """As ``similarity``, with neighbouring letters swapped as one edit."""
    bare = b.rstrip(".")
    if a == bare:
        return 1.0
    if b.endswith(".") and len(bare) >= 2 and a.startswith(bare):
        return 0.95
    if abs(len(a) - len(bare)) > (1 - LEAST_SIMILAR) * max(len(a), len(bare)):
        return 0.0
    if len(bare) > 64 and not set(zip(a, a[1:])) & set(zip(bare, bare[1:])):
        return 0.0
    before: list[int] = []
    row = list(range(len(bare) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(bare, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == bare[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return 1 - row[-1] / max(len(a), len(bare))


def name_features(a: list[str], b: list[str], known: set[str], optional: frozenset[str]) -> tuple[float, float, float, int, str, str, float]:
    """brand, lowest and summed similarity of the other words with a counterpart, their number, the words without one on either side, grade.

    ``a`` leads with its brand; ``known`` words of ``b`` occur in the left table, so they are no misspelling of another word.
    """
    core, grades = [w for w in a if w not in optional], {w for w in a if w in optional}
    other, theirs = [w for w in b if w not in optional], {w for w in b if w in optional}
    both = 1.0 if grades == theirs else 0.0 if grades and theirs and not grades & theirs else 0.5
    scores = []
    for i, w in enumerate(core):
        for j, v in enumerate(other):
            s = 1.0 if v == w else 0.0 if v in known else word_similarity(w, v)
            if s >= LEAST_SIMILAR:
                scores.append((s, -i, -j))
    scores.sort(reverse=True)
    best: dict[int, float] = {}
    used: set[int] = set()
    for s, i, j in scores:  # greedy, the most similar words first; each word once
        if -i not in best and -j not in used:
            best[-i] = s
            used.add(-j)
    rest = [s for i, s in best.items() if i]
    lacking = " ".join(sorted(w for i, w in enumerate(core) if i and i not in best))
    spare = " ".join(sorted(w for j, w in enumerate(other) if j not in used))
    return best.get(0, 0.0), min(rest, default=0.0), float(sum(rest)), max(0, len(core) - 1), lacking, spare, both


def pair_features(pairs: DataFrame, known: DataFrame, left: DataFrame, right: DataFrame, optional: set[str]) -> DataFrame:
    """The pairs with their name features, prices and categories."""
    lcols = left.select(F.col("rec").alias("lrec"), F.col("words").alias("lwords"), "prices", F.col("category").alias("lcat"))
    rcols = right.select(F.col("rec").alias("rrec"), F.col("words").alias("rwords"), F.col("price").alias("rprice"), F.col("category").alias("rcat"))
    joined = pairs.join(shuffled(lcols), "lrec").join(shuffled(rcols), "rrec").join(shuffled(known), "rrec", "left")
    gap = F.array_min(F.transform("prices", lambda p: F.abs(F.ln(F.col("rprice") / p))))
    joined = joined.select("lrec", "rrec", "lwords", "rwords", "known", gap.alias("gap"), "lcat", "rcat")
    loose = frozenset(optional)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [name_features(list(a), list(b), set() if k is None else set(k), loose) for a, b, k in zip(f["lwords"], f["rwords"], f["known"])]
            out = pd.DataFrame(got, columns=["brand", "lowest", "total", "n_rest", "lacking", "spare", "grade"], index=f.index)
            gap = f["gap"].to_numpy(float)
            none = np.isnan(gap)
            out["price"], out["no_price"] = np.where(none, 0.0, np.minimum(3.0, gap)), none.astype(float)
            yield pd.concat([f[["lrec", "rrec", "lcat", "rcat"]], out], axis=1)

    cols = "brand double, lowest double, total double, n_rest int, lacking string, spare string, grade double, price double, no_price double"
    return joined.mapInPandas(run, f"lrec long, rrec long, lcat string, rcat string, {cols}")


def learn_wording(sample: pd.DataFrame, unknown: set[str]) -> set[tuple[str, str]]:
    """(spare, lacking) words by which names of one thing differ: where they are all that differs, prices mostly agree.

    Spare words must hold one that the left table never uses, or none at all.
    """
    f = sample[(sample["brand"] >= 0.95) & (sample["no_price"] == 0) & ((sample["spare"] != "") | (sample["lacking"] != ""))]
    f = f[[s == "" or any(w in unknown for w in s.split()) for s in f["spare"]]]
    if f.empty:
        return set()
    f = f.assign(like=(f["price"] <= LIKE_PRICE).astype(int))
    by = f.groupby(["spare", "lacking"])["like"].agg(["sum", "count"]).reset_index()
    return agreed_wording(by.assign(most=by.groupby("spare")["sum"].transform("sum")))


def agreed_wording(by: pd.DataFrame) -> set[tuple[str, str]]:
    """The (spare, lacking) whose pairs are like-priced (``sum``) often enough among their own (``count``) and those of the spare words (``most``)."""
    good = (by["sum"] >= WORDING_PAIRS) & (by["sum"] >= WORDING_SHARE * by["count"]) & ((by["spare"] == "") | (by["sum"] >= 0.5 * by["most"]))
    return set(zip(by["spare"][good], by["lacking"][good]))


class Wordings:
    """(spare, lacking) of the learned wordings: a table, as there are the more of them the more spellings the names have."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return bool(self.table.filter((F.col("spare") == F.lit(pair[0])) & (F.col("lacking") == F.lit(pair[1]))).head(1))

    def marked(self, rated: DataFrame) -> DataFrame:
        """The pairs with ``said``: whether the words that differ are a wording."""
        return rated.join(self.table.withColumn("is_said", F.lit(True)), ["spare", "lacking"], "left").withColumn("said", F.coalesce("is_said", F.lit(False))).drop("is_said")


def learn_wording_of_all(rated: DataFrame, used: DataFrame) -> Wordings:
    """As ``learn_wording``, by the same rule, over all rated pairs and in tables alone; ``used`` has the left table's words."""
    f = rated.filter((F.col("brand") >= 0.95) & (F.col("no_price") == 0) & ((F.col("spare") != "") | (F.col("lacking") != "")))
    by = materialise(f.groupBy("spare", "lacking").agg(F.sum((F.col("price") <= LIKE_PRICE).cast("long")).alias("sum"), F.count(F.lit(1)).alias("count")).filter("sum > 0"), "differences")
    words = by.filter("spare != ''").select("spare").distinct().select("spare", F.explode(F.split("spare", " ")).alias("word"))
    new = words.join(shuffled(used.select(F.col("w").alias("known"))), F.regexp_replace("word", "[.]", "") == F.col("known"), "left_anti").select("spare").distinct()
    most = by.join(shuffled(new), "spare", "left_semi").groupBy("spare").agg(F.sum("sum").alias("most"))
    often = by.filter((F.col("sum") >= WORDING_PAIRS) & (F.col("sum") >= WORDING_SHARE * F.col("count"))).join(shuffled(most), "spare", "left")
    return Wordings(materialise(often.filter("spare = '' or sum >= 0.5 * most").select("spare", "lacking"), "wordings"))


def final_features(f: pd.DataFrame) -> pd.DataFrame:
    """cover, mean and extra, with the learned wordings (pairs that are ``said``) taken into account."""
    said = f["said"].to_numpy(bool)
    lacking = np.array([len(x.split()) for x in f["lacking"]], float)
    spare = np.array([len(x.split()) for x in f["spare"]], float)
    lowest, n = f["lowest"].to_numpy(float), np.maximum(1, f["n_rest"].to_numpy(float))
    cover = np.where(lacking == 0, lowest, np.where(said, np.minimum(0.9, lowest), 0.0))
    mean = (f["total"].to_numpy(float) + np.where(said, 0.9 * lacking, 0.0)) / n
    extra = np.where(said, 0.0, spare)
    return f.assign(cover=cover, mean=mean, extra=extra)


def price_classes(f: pd.DataFrame) -> np.ndarray:
    """The class of the price difference of every pair, -1 without prices."""
    return np.where(f["no_price"] == 1, -1, np.searchsorted(GAPS, f["price"].to_numpy(float)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class MatchModel:
    weights: np.ndarray
    scale: float
    shift: float
    price: np.ndarray  # for each class of price differences, what it adds to the log odds of a match; 0 for none
    category: dict[tuple[str, str], float]
    wording: Wordings | None

    def matrix(self, f: pd.DataFrame) -> np.ndarray:
        seen = [self.category.get((a, b), self.category.get(("", ""), 0.0)) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(f["lcat"], f["rcat"])]
        f = f.assign(category=[x or 0.0 for x in seen], no_category=[float(x is None) for x in seen])
        return np.c_[np.ones(len(f)), f[list(FEATURES)].to_numpy(float)]

    def confidence(self, f: pd.DataFrame) -> np.ndarray:
        f = final_features(f)
        return _sigmoid(self.scale * (self.matrix(f) @ self.weights) + self.shift + self.price[price_classes(f)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, prior: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, held to ``prior`` by a ridge; ``y`` may be any numbers from 0 to 1."""
    w = start.astype(float).copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * (w - prior)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def category_lift(f: pd.DataFrame, same: np.ndarray) -> dict[tuple[str, str], float]:
    """Smoothed log lift of the pairs of categories among likely matches; ("", "") stands for pairs never seen."""
    cats = f[same > 0.5].dropna(subset=["lcat", "rcat"])
    if not len(cats):
        return {}
    pair, one, two = cats.groupby(["lcat", "rcat"]).size(), cats.groupby("lcat").size(), cats.groupby("rcat").size()
    lift = {(a, b): float(np.log((k + 0.5) * len(cats) / (one[a] * two[b] + 0.5 * len(cats)))) for (a, b), k in pair.items()}
    return lift | {("", ""): float(np.log(0.5 * len(cats) / (one.mean() * two.mean() + 0.5 * len(cats))))}


def train(sample: pd.DataFrame, wording: Wordings | None, rounds: int = 25) -> MatchModel:
    """Fit on two thirds of the pairs, calibrate on the rest (Platt).

    The weak label of a pair is the class of its price difference: it agrees far
    more often if both names stand for one thing, and given that, it doesn't
    depend on how the names are written.  Expectation maximisation finds how
    often, and the weights of the names with it.  It is the same at every size:
    with few pairs the weights stay near PRIOR_WEIGHTS, and without prices there.
    """
    f = final_features(sample)
    gap, fit = price_classes(f), np.arange(len(f)) % 3 != 0
    prior = np.array(PRIOR_WEIGHTS)
    model = MatchModel(prior, 1.0, 0.0, np.zeros(len(GAPS) + 2), {}, wording)

    def shares(at: np.ndarray, weight: np.ndarray, before: tuple) -> np.ndarray:
        seen = np.bincount(at, weight, minlength=len(GAPS) + 1) + 10 * np.array(before)
        return seen / seen.sum()

    x = model.matrix(f)
    same = _sigmoid(x @ prior)
    for k in range(rounds):
        if k < 3:  # what belongs together is known well enough by then
            model.category = category_lift(f[fit], same[fit])
            x = model.matrix(f)
        seen = fit & (gap >= 0)
        model.price = np.r_[np.log(shares(gap[seen], same[seen], PRIOR_SAME) / shares(gap[seen], 1 - same[seen], PRIOR_OTHER)), 0.0]
        same = _sigmoid(x @ model.weights + model.price[gap])
        before, model.weights = model.weights, _logistic(x[fit], same[fit], RIDGE, prior, model.weights)
        if np.abs(before - model.weights).max() < 1e-3:
            break
    names = np.c_[x[~fit] @ model.weights, np.ones((~fit).sum())]
    line = np.array([1.0, 0.0])
    for _ in range(rounds):  # the held-out pairs say how far the names' odds can be trusted
        target = _sigmoid(names @ line + model.price[gap[~fit]])
        line = _logistic(names, target, LINE_RIDGE, np.array([1.0, 0.0]), line)
    model.scale, model.shift = max(0.05, float(line[0])), float(line[1])
    return model


def confidences(rated: DataFrame, model: MatchModel) -> DataFrame:
    """``(lrec, rrec, confidence)`` of all rated pairs."""
    model = replace(model, wording=None)  # the pairs say what is one

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = model.confidence(f) if len(f) else np.empty(0)
            yield pd.DataFrame({"lrec": f["lrec"], "rrec": f["rrec"], "confidence": p})

    return rated.mapInPandas(rate, "lrec long, rrec long, confidence double")


def rated_pairs(left: Side, right: Side, optional: tuple[str, ...] = (), heavy_block: int = HEAVY_BLOCK) -> tuple[DataFrame, MatchModel]:
    """The compared pairs with their features, written down, and the model fitted on a sample of them."""
    ship_package(left.df.sparkSession)
    # each step is used several times; written down, the plans stay short
    lrecs, rrecs = materialise(leading_records(left), "left"), materialise(records(right), "right")
    loose = {*optional, *learn_optional(lrecs, rrecs)}
    b = blocks(lrecs, rrecs, loose, heavy_block)
    rated = materialise(pair_features(all_candidates(b), b.known, lrecs, rrecs, loose), "rated")
    wording = learn_wording_of_all(rated, lrecs.select(F.explode("words").alias("w")).distinct())
    share = min(1.0, SAMPLE / max(1, rated.count()))
    rated = wording.marked(rated)
    chosen = F.pmod(F.xxhash64("lrec", "rrec", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    sample = rated.filter(chosen).toArrow().to_pandas().sort_values(["lrec", "rrec"]).reset_index(drop=True)
    return rated, train(sample, wording)


def match_entities(left: Side, right: Side, optional: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """``(left_id, right_id, confidence)``: for every right id its best left id, if its confidence reaches ``threshold``.

    ``optional`` words may differ between names of one thing, beside those that
    are learned.  A null or empty name, or one of optional words alone, matches
    nothing; null prices and categories, and prices that aren't positive numbers,
    are no evidence; equal right records are compared once and every id of theirs
    comes out; of left rows whose names have the same words the lowest id stands
    for all, with the prices of all (``left_members`` has the others); ties go to
    the lowest id; empty tables give an empty result; other columns are ignored.
    Optional words and wordings are learned from all names and pairs; the model is
    fitted on about SAMPLE pairs at most, chosen by hash; all pairs are rated.
    """
    rated = confidences(*rated_pairs(left, right, optional)).filter(F.col("confidence") >= threshold)

    def ids(side: Side, rec: str, row_id: str) -> DataFrame:
        d = side.df.select(
            F.col(f"`{side.row_id}`").cast("long").alias(row_id), F.col(f"`{side.name}`").cast("string").alias("name"),
            (F.col(f"`{side.price}`") if side.price else F.lit(None)).cast("double").alias("price"), (F.col(f"`{side.category}`") if side.category else F.lit(None)).cast("string").alias("category"),
        ).filter(F.col("name").isNotNull() & F.col(row_id).isNotNull())
        d = d.withColumn("price", F.when((F.col("price") > 0) & (F.col("price") < 1e15), F.col("price")))
        return d.select(record_id().alias(rec), row_id).distinct()

    best = Window.partitionBy("rrec").orderBy(F.desc("confidence"), "left_id")
    matched = rated.withColumnRenamed("lrec", "left_id").withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    one = matched.join(shuffled(ids(right, "rrec", "right_id")), "rrec")
    # several records of one right id: the surest, then the lowest
    top = one.groupBy("right_id").agg(F.max_by(F.struct("left_id", "confidence"), F.struct("confidence", -F.col("left_id"))).alias("m"))
    return top.select("m.left_id", "right_id", "m.confidence")
