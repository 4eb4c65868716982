"""Quantities recorded in different units.

Values come as text ("12 - 3/4 lb bags", "EUR 7.63") or as bare numbers whose
unit depends on the source.  Text is read with a small grammar.  For bare
numbers, records of different sources that stand for the same thing are linked,
a robust scale and offset is estimated for each pair of sources, snapped to the
ratio of two known units, and spread through the graph of sources from those
whose unit is known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise, ship_package

#: Spellings of the units, by the name they have in the table of units (lower case, final dots removed).
SPELLINGS = {
    "mg": "mg mgs milligram milligrams",
    "g": "g gs gm gms gr grs gram grams gramme grammes",
    "kg": "kg kgs kilo kilos kilogram kilograms",
    "oz": "oz ozs ounce ounces",
    "lb": "lb lbs pound pounds",
    "ml": "ml mls millilitre millilitres milliliter milliliters",
    "cl": "cl cls centilitre centilitres centiliter centiliters",
    "dl": "dl dls decilitre decilitres deciliter deciliters",
    "l": "l lt ltr ltrs litre litres liter liters",
    "pt": "pt pts pint pints",
    "gal": "gal gals gallon gallons",
    "dozen": "dozen dozens doz dz",
}
MONEY = {"EUR": "eur euro euros €", "USD": "usd us$ $ dollar dollars", "GBP": "gbp £ sterling", "cent": "c ct cts cent cents ¢"}
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8"}
#: Size of the table of units that the driver may hold.
MOST_UNITS = 10_000
#: Every source of a thing is held against the anchor and against so many others, in an order that differs from thing to thing.
NEIGHBOURS = 8
#: What is known of the spread of a pair of sources before seeing any link, and how many links that is worth.
PRIOR_SPREAD, PRIOR_LINKS = 0.1, 2
#: An offset speaks against a mere scale beyond so many standard errors of what the line leaves, and more where there are fewer links than this.
OFFSET_ERRORS, OFFSET_LINKS = 8.0, 15
#: A unit is taken if its logarithm lies within this of the estimate, and the next one is farther off by so many standard errors.
TOLERANCE, CLEAR = 0.25, 2.0

_UNIT = {s: u for u, spelled in SPELLINGS.items() for s in spelled.split()}
_MONEY = {s: u for u, spelled in MONEY.items() for s in spelled.split()}
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\s\w]|_")
_FLUID = re.compile(r"\b(?:fluid|fl)\b\.?\s*(?:ounces?|ozs?)\b\.?")
_PRICE = re.compile(r"([^\d\s.,'+-][^\d.,'+-]*)?(\d[\d.,' ]*\d|\d)([^\d.,'+-]*)")


def number(text: str) -> Decimal:
    """"1,25" and "1.25" are decimals; with several marks the last one is the decimal mark unless it repeats."""
    marks = re.findall(r"[.,]", text)
    if not marks:
        return Decimal(text)
    last = marks[-1]
    if marks.count(last) > 1:
        return Decimal(re.sub(r"[.,]", "", text))
    whole, _, part = text.rpartition(last)
    return Decimal(re.sub(r"[.,]", "", whole) + "." + part)


def read_pack(text: str | None) -> list[tuple[str, Decimal]]:
    """Content of a pack by unit name; counts multiply every part of a compound measure. Empty if it can't be read."""
    if text is None:
        return []
    s = text.lower().replace("×", " x ")
    for mark, plain in FRACTIONS.items():
        s = s.replace(mark, f" {plain} ")
    s = re.sub(r"\bhalf(?:\s+an?)?\b", " 1/2 ", s)
    s = _FLUID.sub(" floz ", s)
    s = re.sub(r"(\d)\s*x\s*(?=\d)", r"\1 x ", s)
    tokens = _TOKEN.findall(s)
    counts: list[Decimal] = []
    measures: list[tuple[str, Decimal]] = []
    i, joined = 0, False  # joined: the last measure may be continued
    while i < len(tokens):
        t = tokens[i]
        value = None
        if t[0].isdigit():
            if not t.isascii():
                return []
            value, i = number(t), i + 1
            if i + 1 < len(tokens) and tokens[i] == "/" and tokens[i + 1].isdigit():
                if int(tokens[i + 1]) == 0:
                    return []
                value, i = value / Decimal(tokens[i + 1]), i + 2
            elif i + 2 < len(tokens) and tokens[i].isdigit() and tokens[i + 1] == "/" and tokens[i + 2].isdigit() and int(tokens[i + 2]):
                value, i = value + Decimal(tokens[i]) / Decimal(tokens[i + 2]), i + 3
        elif t in NUMBER_WORDS:
            value, i = Decimal(NUMBER_WORDS[t]), i + 1
        elif t == "dozen" or _UNIT.get(t) == "dozen":
            counts.append(Decimal(12))
            i, joined = i + 1, False
            continue
        else:
            if t not in (".", "and", "+", "&"):
                joined = False
            i += 1
            continue
        unit = None
        if i < len(tokens):
            unit = "fl oz" if tokens[i] == "floz" else _UNIT.get(tokens[i])
        if unit is None or unit == "dozen":
            counts.append(value)
            joined = False
            continue
        i += 1
        if measures and not joined:
            continue  # the same content said again in another unit
        measures.append((unit, value))
        joined = True
    if not counts and not measures:
        return []
    times = math.prod(counts, start=Decimal(1))
    return [(unit, times * value) for unit, value in measures] or [("piece", times)]


def read_price(text: str | None) -> tuple[str | None, Decimal] | None:
    """Unit name (None: a bare number) and amount; a price has no decimals or two."""
    if text is None:
        return None
    m = _PRICE.fullmatch(text.strip().lower().replace("\u00a0", " "))
    if not m:
        return None
    names = [w.strip().rstrip(".").strip() for w in (m[1] or "", m[3] or "") if w.strip()]
    units = {_MONEY.get(w) for w in names}
    if None in units or len(units) > 1:
        return None
    digits = m[2].replace(" ", "").replace("'", "")
    cut = re.fullmatch(r"([\d.,]*?)(?:[.,](\d\d))?", digits)
    if not cut or not cut[1] or not re.fullmatch(r"\d+|\d{1,3}(?:([.,])\d{3})(?:\1\d{3})*", cut[1]):
        return None
    value = Decimal(re.sub(r"[.,]", "", cut[1]) + ("." + cut[2] if cut[2] else ""))
    return (units.pop() if units else None), value


def half_up(x: Decimal) -> int:
    return int(x.quantize(Decimal(1), ROUND_HALF_UP))


def known_units(measure_units: DataFrame) -> dict[str, tuple[str, str, Decimal]]:
    """name -> (kind, base unit, to_base); the table is held on the driver, so its size is checked."""
    rows = measure_units.select("unit_name", "unit_kind", "base_unit", "to_base").filter("unit_name is not null").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    return {r[0]: (r[1], r[2], Decimal(repr(r[3]))) for r in rows}


ANCHOR = "anchor"


def source_edges(values: DataFrame, source: str, entity: str, value: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(a, b, n, ratio, offset, var)``: robust scale (as a logarithm) and offset of pairs of sources that record the same entities.

    ``values`` is first brought to one row (the median) per source and entity.
    The sources of an entity are put in an order that depends on the entity and
    each is paired with the anchor and the next few, so the work grows with the
    values and not with the square of the sources; over all entities any two
    sources can meet.  The ratio is the median of logarithms.  The offset, as a
    share of the values, is that of the resistant line through the medians of the
    lowest and the highest third.  ``var`` is the variance of the ratio: from the
    median deviation, held against a prior spread where links are few, and what
    an offset beyond its own error says against a mere scale.
    """
    v = (
        values.select(F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{entity}`").alias("e"), F.col(f"`{value}`").cast("double").alias("v"))
        .filter("s is not null and e is not null and v > 0 and v < 1e300")
        .groupBy("s", "e")
        .agg(F.percentile_approx("v", 0.5, 1000).alias("v"))
    )
    # the anchor first, the others by a hash; a list is as long as there are sources
    lists = v.groupBy("e").agg(F.sort_array(F.collect_list(F.struct((F.col("s") != ANCHOR).alias("o"), F.xxhash64("e", "s").alias("h"), "s", "v"))).alias("l")).filter(F.size("l") > 1)
    at = lists.select("l", F.posexplode("l").alias("i", "x"))
    others = F.slice("l", F.col("i") + 2, F.when((F.col("i") == 0) & ~F.col("x.o"), F.size("l")).otherwise(neighbours))
    pairs = at.select("x", F.explode(others).alias("y"))
    swap = F.col("x.s") > F.col("y.s")
    a, b = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    pairs = pairs.select(a.alias("x"), b.alias("y")).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.v").alias("va"), F.col("y.v").alias("vb"), F.ln(F.col("y.v") / F.col("x.v")).alias("r"))
    pairs = materialise(pairs, "links")
    mid = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", 0.5, 1000).alias("ratio"), F.percentile_approx("va", [1 / 3, 2 / 3], 1000).alias("thirds"))
    low, high = F.col("va") <= F.col("thirds")[0], F.col("va") >= F.col("thirds")[1]

    def median(x: Column) -> Column:
        return F.percentile_approx(x, 0.5, 1000)

    rest = pairs.join(mid, ["a", "b"]).groupBy("a", "b").agg(
        F.first("n").alias("n"), F.first("ratio").alias("ratio"), median(F.abs(F.col("r") - F.col("ratio"))).alias("spread"),
        median(F.when(low, F.col("va"))).alias("x1"), median(F.when(low, F.col("vb"))).alias("y1"), median(F.when(high, F.col("va"))).alias("x2"), median(F.when(high, F.col("vb"))).alias("y2"),
    )
    # without a spread of values there is no line: the scale alone
    slope = F.when(F.col("x2") > F.col("x1"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).otherwise(F.exp("ratio"))
    line = rest.select("a", "b", "n", "ratio", "spread", slope.alias("slope"))
    left = F.col("vb") - F.col("slope") * F.col("va")
    lines = pairs.join(line, ["a", "b"]).groupBy("a", "b").agg(
        F.first("n").alias("n"), F.first("ratio").alias("ratio"), F.first("spread").alias("spread"), F.percentile_approx(left, [0.25, 0.5, 0.75], 1000).alias("left"), median(F.col("vb")).alias("usual")
    )

    def error(spread: Column) -> Column:
        """Standard error of a median of n values by their median deviation, few of them held against what is known before."""
        return 1.86 * F.sqrt((F.col("n") * F.pow(spread, F.lit(2)) + PRIOR_LINKS * PRIOR_SPREAD**2) / (F.col("n") + PRIOR_LINKS) / F.col("n"))

    offset = F.col("left")[1] / F.col("usual")
    beyond = F.greatest(F.lit(0.0), F.abs(offset) - OFFSET_ERRORS * (1 + OFFSET_LINKS / F.col("n")) * error((F.col("left")[2] - F.col("left")[0]) / 2 / F.col("usual")))
    return lines.select("a", "b", "n", "ratio", offset.alias("offset"), (F.pow(error(F.col("spread")), F.lit(2)) + F.pow(beyond, F.lit(2))).alias("var"))


def spread_units(edges: DataFrame, anchor_unit: str, units: dict[str, tuple[str, str, Decimal]], kind: str) -> DataFrame:
    """``(s, unit, n, distance)`` of every source whose unit the graph tells, spread from the anchor.

    In every round the sources that known ones lead to get the mean of what their
    edges say, weighed by the inverse of the variance along the way; it is
    snapped to the known unit nearest in logarithm.  A source whose evidence
    doesn't set the nearest unit clearly apart from the next stays open and may
    be decided in a later round.  Edges and units of sources stay in tables; a
    round is a join.
    """
    spark = edges.sparkSession
    factors = {u: math.log(float(f)) for u, (k, _, f) in units.items() if k == kind}
    both = materialise(edges.select("a", "b", "n", "ratio", "var").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", (-F.col("ratio")).alias("ratio"), "var")), "edges")
    known = spark.createDataFrame([(ANCHOR, anchor_unit, factors[anchor_unit], 0.0, 0, 0.0)], "s string, unit string, log double, var double, n long, distance double")
    while True:
        reached = known.select(F.col("s").alias("a"), "log", F.col("var").alias("var0")).join(both, "a").join(known.select(F.col("s").alias("b")), "b", "left_anti")
        # values of b = scale * values of a, so one unit of b is 1/scale of a unit of a
        weight = 1 / (F.col("var") + F.col("var0"))
        told = reached.groupBy("b").agg((F.sum((F.col("log") - F.col("ratio")) * weight) / F.sum(weight)).alias("want"), (1 / F.sum(weight)).alias("var"), F.sum("n").alias("n"))
        near = F.sort_array(F.array(*(F.struct(F.abs(F.lit(x) - F.col("want")).alias("d"), F.lit(u).alias("unit"), F.lit(x).alias("log")) for u, x in sorted(factors.items()))))
        told = told.withColumn("near", near).filter(F.col("near")[0]["d"] <= TOLERANCE)
        if len(factors) > 1:
            told = told.filter(F.col("near")[1]["d"] - F.col("near")[0]["d"] >= CLEAR * F.sqrt("var"))
        new = told.select(F.col("b").alias("s"), F.col("near")[0]["unit"].alias("unit"), F.col("near")[0]["log"].alias("log"), "var", "n", F.col("near")[0]["d"].alias("distance"))
        grown = materialise(known.unionByName(new), "sources")
        if grown.count() == known.count():
            return known.filter(F.col("s") != ANCHOR).select("s", "unit", "n", "distance")
        known = grown


def name_key(name: Column) -> Column:
    """Words of a name in lower case without accents, in order of the alphabet: the same for names that differ in wording only."""
    plain = F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    plain = F.regexp_replace(plain, r",\s*[^,]*[0-9½].*$", "")
    plain = F.regexp_replace(plain, r"'s\b|\bby\b|\bnew\b|\(retail\)", " ")
    words = F.array_distinct(F.filter(F.split(plain, r"[^a-z]+"), lambda w: F.length(w) > 1))
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " "))


def price_sources(prices: DataFrame, source: str, price: str, name: str, anchor: DataFrame, anchor_price: str, anchor_name: str, anchor_unit: str, units: dict) -> DataFrame:
    """``(source, unit, n_links, distance)``: the unit of bare prices in every source, from the graph of sources anchored at a table with a known unit."""
    bare = F.col("p").rlike(r"^\s*[0-9]+([.,][0-9]{2})?\s*$")
    p = prices.select(F.concat(F.lit("source:"), F.col(f"`{source}`").cast("string")).alias("s"), F.col(f"`{price}`").cast("string").alias("p"), name_key(F.col(f"`{name}`")).alias("e")).filter(bare)
    p = p.select("s", "e", F.translate(F.trim("p"), ",", ".").try_cast("double").alias("v"))
    a = anchor.select(F.lit(ANCHOR).alias("s"), name_key(F.col(f"`{anchor_name}`")).alias("e"), F.col(f"`{anchor_price}`").cast("double").alias("v"))
    found = spread_units(source_edges(p.unionByName(a), "s", "e", "v"), anchor_unit, units, "money")
    return found.select(F.regexp_replace("s", "^source:", "").alias("source"), "unit", F.col("n").alias("n_links"), "distance")


def declared_sources(feeds: DataFrame, source: str, unit: str) -> DataFrame:
    """``(source, declared)``: one row per source that says what its bare numbers mean; of several the first in order of the alphabet."""
    return feeds.select(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{unit}`").alias("declared")).dropna().groupBy("source").agg(F.min("declared").alias("declared"))


def source_units(estimated: DataFrame, declared: DataFrame) -> DataFrame:
    """``(source, unit)``: what the graph says; a source that it leaves open has the unit declared."""
    return estimated.select("source", "unit").join(declared, "source", "full").select("source", F.coalesce("unit", "declared").alias("unit"))


def convert_pack(units: dict, text: str | None) -> tuple[str, int] | None:
    parts = read_pack(text)
    if not parts or any(u not in units for u, _ in parts) or len({units[u][1] for u, _ in parts}) > 1:
        return None
    total = sum((v * units[u][2] for u, v in parts), Decimal(0))
    return (units[parts[0][0]][1], half_up(total)) if total < 1 << 62 else None


def convert_price(units: dict, text: str | None, bare_unit: str | None) -> tuple[str, int] | None:
    got = read_price(text)
    if got is None:
        return None
    unit = got[0] or bare_unit
    if unit not in units:
        return None
    total = got[1] * units[unit][2]
    return (units[unit][1], half_up(total)) if total < 1 << 62 else None


def each_text_once(convert, *columns: pd.Series) -> list:
    """``convert`` of the rows of some columns, called once for every different row."""
    rows = pd.MultiIndex.from_arrays(columns) if len(columns) > 1 else pd.Index(columns[0])
    codes, different = pd.factorize(rows, use_na_sentinel=False)
    plain = [tuple(None if not isinstance(x, str) else x for x in (r if isinstance(r, tuple) else (r,))) for r in different]
    got = [convert(*r) for r in plain]
    return [got[k] for k in codes]


def common_units(df: DataFrame, row_id: str, pack: str, price: str, source: str, units: dict, sources: DataFrame) -> DataFrame:
    """``(row_id, field_name, base_unit, amount)``: every readable pack and price in its base unit.

    ``sources`` has the unit of bare prices by source.  Amounts are rounded half
    up.  Nulls, texts without a number, unknown units, and bare numbers of a
    source without a unit give no row; copies of a row give one.  Other columns
    of ``df`` are ignored.
    """
    ship_package(df.sparkSession)
    d = df.select(
        F.col(f"`{row_id}`").cast("long").alias("row_id"), F.col(f"`{pack}`").cast("string").alias("pack"),
        F.col(f"`{price}`").cast("string").alias("price"), F.col(f"`{source}`").cast("string").alias("source"),
    )
    # a number of parts that is set stays; reading texts is too dear to be left to one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.join(sources.select("source", "unit"), "source", "left").select("row_id", "pack", "price", "unit").repartition(parts, "row_id", "pack", "price", "unit").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            packs = each_text_once(lambda t: convert_pack(units, t), f["pack"])
            costs = each_text_once(lambda t, u: convert_price(units, t, u), f["price"], f["unit"])
            out = [(i, name, *got) for name, column in ((pack, packs), (price, costs)) for i, got in zip(f["row_id"], column) if got is not None]
            yield pd.DataFrame(out, columns=["row_id", "field_name", "base_unit", "amount"])

    return d.mapInPandas(run, "row_id long, field_name string, base_unit string, amount long").distinct().withColumnRenamed("row_id", row_id)
