from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.operators import units as U

KNOWN = {
    n: (k, b, Decimal(f))
    for n, k, b, f in [
        ("g", "mass", "g", "1"), ("kg", "mass", "g", "1000"), ("oz", "mass", "g", "28.349523125"), ("lb", "mass", "g", "453.59237"), ("ml", "volume", "ml", "1"), ("l", "volume", "ml", "1000"),
        ("fl oz", "volume", "ml", "29.5735295625"), ("piece", "count", "piece", "1"), ("dozen", "count", "piece", "12"),
        ("cent", "money", "cent", "1"), ("EUR", "money", "cent", "100"), ("USD", "money", "cent", "92"), ("GBP", "money", "cent", "117"),
    ]
}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12 - 3/4 lb bags", ("g", 4082)), ("1 lb 12 oz", ("g", 794)), ("3 x 2 kg 500 g", ("g", 7500)), ("4x12x250gr", ("g", None)), ("16 oz. x 20", ("g", 9072)),
        ("case of 12 tins (125g)", ("g", 1500)), ("20 x 8 fl.oz", ("ml", 4732)), ("6.8 Fluid Ounces", ("ml", 201)), ("1½ L", ("ml", 1500)), ("0,75 l", ("ml", 750)),
        ("½ dozen", ("piece", 6)), ("half a dozen", ("piece", 6)), ("two dozen", ("piece", 24)), ("24 boxes x 4 bags", ("piece", 96)), ("tray of 24", ("piece", 24)), ("30 Stk", ("piece", 30)),
        ("32×500 g", ("g", 16000)), ("  10 kg ", ("g", 10000)), ("500 g (17.6 oz)", ("g", 500)),
        ("n/a", None), ("", None), (None, None), ("various sizes", None), ("1/0 lb", None), ("9" * 40 + " kg", None),
    ],
)
def test_packs(text, want):
    got = U.convert_pack(KNOWN, text)
    assert got == ((want[0], want[1] if want[1] is not None else 12000) if want else None)


@pytest.mark.parametrize(
    ("text", "source", "want"),
    [
        ("7,74", "isles", 906), ("765", "quay", 765), ("1.851,48", "atlantic", 170336), ("3,162.43 EUR", "quay", 316243), ("US$ 5.00", "north", 460), ("1725 Cent", "north", 1725), ("9 £", "x", 1053), ("1.725", "north", 172500),
        ("7,74", "unknown", None), ("7.74", None, None), ("on request", "north", None), ("", "north", None), (None, "north", None), ("5.5", "north", None), ("-5.00", "north", None), ("EUR 5 USD", "north", None),
    ],
)
def test_prices(text, source, want):
    got = U.convert_price(KNOWN, text, {"north": "EUR", "quay": "cent", "atlantic": "USD", "isles": "GBP"}.get(source))
    assert got == (None if want is None else ("cent", want))


def test_rounding_is_half_up():
    assert [U.half_up(Decimal(x)) for x in ("0.5", "1.5", "2.5", "2.49")] == [1, 2, 3, 2]


def test_units_spread_through_the_graph(spark):
    # north links to the anchor, isles and quay only to north, lone to nobody
    rows = []
    for i in range(40):
        base = 2 + i * 0.7
        rows += [("anchor", f"e{i}", base)] if i < 15 else []
        rows += [("north", f"e{i}", base * (1 + 0.04 * ((i * 7) % 5 - 2)))]
        rows += [("isles", f"e{i}", base / 1.17 * (1 + 0.04 * ((i * 3) % 5 - 2)))] if i >= 15 else []
        rows += [("quay", f"e{i}", base * 100 if i % 6 else base * 3000)] if i >= 20 else []  # one in six far off
    rows += [("lone", "z", 3.0), (None, "e1", 1.0), ("north", None, 1.0), ("north", "e3", None), ("north", "e3", -1.0)]
    df = spark.createDataFrame(rows, "src string, ent string, val double")
    edges = U.source_edges(df, "src", "ent", "val")
    got = U.spread_units(edges, "EUR", KNOWN, "money")
    assert {r.s: r.unit for r in got.collect()} == {"north": "EUR", "isles": "GBP", "quay": "cent"}


def test_an_offset_is_no_scale(spark):
    rows = [("anchor", f"e{i}", 2.0 + i) for i in range(60)] + [("plus", f"e{i}", 2.0 + i + 6) for i in range(60)] + [("same", f"e{i}", (2.0 + i) * (0.97 + 0.02 * (i % 4))) for i in range(60)]
    edges = U.source_edges(spark.createDataFrame(rows, "src string, ent string, val double"), "src", "ent", "val")
    offset = {(r.a, r.b): r.offset for r in edges.collect()}
    assert offset["anchor", "plus"] > 0.1 and abs(offset["anchor", "same"]) < 0.05
    assert {r.s: r.unit for r in U.spread_units(edges, "EUR", KNOWN, "money").collect()} == {"same": "EUR"}


def test_many_sources(spark):
    """Far more sources than an entity has neighbours, and few links for each pair."""
    df = spark.range(200 * 30).select((F.col("id") % 200).alias("k"), F.floor(F.col("id") / 200).alias("i"))
    df = df.select(F.concat(F.lit("s"), "k").alias("src"), F.concat(F.lit("e"), "i").alias("ent"), ((2 + F.col("i") * 0.9) * F.when(F.col("k") % 2 == 0, 100.0).otherwise(1.0)).alias("val"))
    df = df.unionByName(spark.range(30).select(F.lit("anchor").alias("src"), F.concat(F.lit("e"), "id").alias("ent"), (2 + F.col("id") * 0.9).alias("val")))
    edges = U.source_edges(df, "src", "ent", "val", 3)
    assert edges.count() < 200 + 200 * 3 * 30
    got = {r.s: r.unit for r in U.spread_units(edges, "EUR", KNOWN, "money").collect()}
    assert got == {f"s{k}": "cent" if k % 2 == 0 else "EUR" for k in range(200)}


def test_rows_copies_and_clashing_names(spark):
    rows = [(1, "2 kg", "5.00", "north", "x"), (1, "2 kg", "5.00", "north", "x"), (2, None, None, None, "x"), (3, "assorted", "TBD", "north", "x"), (None, "1 g", "1", "quay", "x")]
    df = spark.createDataFrame(rows, "productid long, quantityperunit string, unitprice string, feed string, amount string")
    units = spark.createDataFrame([("north", "EUR"), ("quay", "cent")], "source string, unit string")
    got = U.common_units(df, "productid", "quantityperunit", "unitprice", "feed", KNOWN, units)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "quantityperunit", "g", 2000), (1, "unitprice", "cent", 500), (None, "quantityperunit", "g", 1), (None, "unitprice", "cent", 1)], key=str
    )
    assert U.common_units(df.limit(0), "productid", "quantityperunit", "unitprice", "feed", KNOWN, units).count() == 0
    assert U.common_units(df, "productid", "quantityperunit", "unitprice", "feed", KNOWN, units.limit(0)).count() == 2


def test_name_key(spark):
    df = spark.createDataFrame([("Sichopum's Mild Cinnamon Pralines",), ("PRALINES, MILD CINNAMON - SÍCHOPUM",), ("Mild Cinnamon Pralines by Sichopum, 40 x 5 g",), (None,), ("12",)], "n string")
    got = [r[0] for r in df.select(U.name_key(df.n)).collect()]
    assert got == ["cinnamon mild pralines sichopum"] * 3 + [None] * 2
