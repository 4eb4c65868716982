import math

import pytest
from pyspark.sql import functions as F

from weftline.errors import EngineError
from weftline.functions.formula import parse
from weftline.functions.scalars import epoch_seconds, safe_div, to_number


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("7 % 4", 3), ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("[A] * 2", 6), ("[ A ] + [B C]", 7.5), ("sqrt(16) + abs(-2)", 6),
        ("log(e) + floor(2.7) + cos(0)", 4), ("2e3 + .5", 2000.5), ("pi", math.pi), ("SIGNUM(-3)", -1), ("[S] + 1", 13),
    ],
)
def test_values(spark, text, want):
    df = spark.createDataFrame([(3.0, 4.5, "12")], "A double, `B C` double, S string")
    got = df.select(parse(text).column(lambda p: F.col(f"`{p[0]}`")).alias("x")).first()[0]
    assert math.isclose(got, want)


def test_nulls_and_empty_texts_are_nan(spark):
    df = spark.createDataFrame([(None, "")], "A double, S string")
    got = df.select(*(parse(t).column(lambda p: F.col(p[0])).alias(f"c{i}") for i, t in enumerate(("[A] + 1", "[S] * 2", "[A]")))).first()
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2] is None


@pytest.mark.parametrize("text", ["", "1 +", "(1", "[A", "[] + 1", "foo(1)", "1 2", "foo", "[A] $ 2", "sqrt 2"])
def test_what_cannot_be_read_raises(text):
    with pytest.raises(EngineError):
        parse(text)


def test_paths_and_out():
    f = parse("[out] + [A].[B] * [A]. [B] + [C]")
    assert f.paths == (("out",), ("A", "B"), ("C",)) and f.uses_out() and not f.identity and parse("[x].[y]").identity
    with pytest.raises(EngineError):
        f.column(lambda p: F.col(p[0]))


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_div(df.a, df.b)).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3:] == [None, 2.0]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("abc",)], "a string").select(to_number(F.col("a"))).collect()
    assert spark.sql("select timestamp_ntz'1970-01-01 00:00:01.5' t").select(epoch_seconds(F.col("t"))).first()[0] == 1.5
