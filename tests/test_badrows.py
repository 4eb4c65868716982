import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.badrows import DIGITS, BlockParser, FieldRule, RecordSpec, failed_records, parse_records, split_strict
from weftline.queries_data import CATEGORY_FILE, PRODUCT_FILE

SPEC = RecordSpec((FieldRule("a", "long", must=DIGITS), FieldRule("b", blank_ok=False), FieldRule("c", "double", must=r"\A[0-9]*\z")))


def brute(text):
    """Field by field, character by character."""
    fields, cur, state = [], "", "start"
    for ch in text:
        if state == "start":
            if ch == '"':
                state = "quoted"
            elif ch == ",":
                fields.append("")
            else:
                cur, state = ch, "plain"
        elif state == "plain":
            if ch == ",":
                fields.append(cur)
                cur, state = "", "start"
            elif ch == '"':
                return None
            else:
                cur += ch
        elif state == "quoted":
            if ch == '"':
                state = "closed"
            else:
                cur += ch
        elif ch == '"':
            cur, state = cur + '"', "quoted"
        elif ch == ",":
            fields.append(cur)
            cur, state = "", "start"
        else:
            return None
    return None if state == "quoted" else [*fields, cur]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a1,"\n \r', max_size=14))
def test_strict_split(text):
    assert split_strict(text) == brute(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='a1,"\n \r\x00\xa0\x85', max_size=8) | st.sampled_from(["1,a,2", '1,"a""b",', "7, x ,3"]), max_size=12))
def test_blocks_agree_with_single_records(texts):
    parser = BlockParser(SPEC)
    got = [None] * len(texts)
    for at, cols, told in parser.parse(pa.array(texts, pa.string())):
        for i, k in enumerate(at):
            got[k] = (None, [c[i].as_py() for c in cols]) if cols is not None else (told[i][0], told[i][2])
    want = [(r, v) for r, _, v in (BlockParser(SPEC).strict(t) for t in texts)]
    assert got == want


CASES = [
    ('1,"A, b",2,"12 - 5 oz ""tins""",3.5,4,,,FALSCH', None),
    ("1,A,2,12 x 1 l,3,4,5,6,WAHR", None),
    ('1,"A,2,12 x 1 l,3,4,5,6,WAHR', "quoting"),
    ('1,A"b,2,12 x 1 l,3,4,5,6,WAHR', "quoting"),
    ('1,"A" ,2,12 x 1 l,3,4,5,6,WAHR', "quoting"),
    ("1,A,2,12 x 1 l,3,4,5,6", "columns"),
    ("", "columns"),
    (None, "columns"),
    ("1,A,2,12 x 1 l,3.,4,5,6,WAHR", "value"),
    ("1, ,2,12 x 1 l,3,4,5,6,WAHR", "value"),
    (" 1,A,2,12 x 1 l,3,4,5,6,WAHR", "value"),
    ("1,A,2,dozen,3,4,5,6,WAHR", "value"),
    ("1,A,2,٤ x l,3,4,5,6,WAHR", "value"),
    ('1,A,2,"12\n x",3,4,5,6,WAHR', "value"),
    ("1,A,2,12 �,3,4,5,6,WAHR", "value"),
    ("1,A,2,12 x,3,4,5,6,wahr", "value"),
    ("99999999999999999999,A,2,12 x,3,4,5,6,WAHR", None),
]


def test_product_records(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES * 3)]
    df = spark.createDataFrame(rows, "line_id int, raw_text string, other string")
    got = {r.line_id: r for r in parse_records(df, PRODUCT_FILE, "raw_text", ["line_id"]).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: CASES[i % len(CASES)][1] for i in range(len(rows))}
    assert got[0].ProductName == "A, b" and got[0].QuantityPerUnit == '12 - 5 oz "tins"' and got[0].UnitsOnOrder is None and got[0].UnitPrice == 3.5
    assert got[16].ProductID is None and got[16].ProductName == "A"


def test_category_records(spark):
    rows = [(1, '4,"Fish","Line one\nline\ttwo"'), (2, "4,Fish,a\x0cb"), (3, "4,Fish, "), (4, "4,Fish,x\r")]
    df = spark.createDataFrame(rows, "line_id int, raw_text string")
    assert {r.line_id: r.reason for r in parse_records(df, CATEGORY_FILE, "raw_text", ["line_id"]).collect()} == {1: None, 2: "value", 3: "value", 4: "value"}


def test_empty_table_long_text_and_clash(spark):
    df = spark.createDataFrame([], "line_id int, raw_text string")
    assert parse_records(df, CATEGORY_FILE, "raw_text", ["line_id"]).count() == 0
    long = spark.createDataFrame([(1, "1,a," + "x" * 2_000_000), (2, '1,a,"' + "x" * 2_000_000)], "line_id int, raw_text string")
    assert {r.line_id: r.reason for r in parse_records(long, CATEGORY_FILE, "raw_text", ["line_id"]).select("line_id", "reason").collect()} == {1: None, 2: "quoting"}
    with pytest.raises(ValueError):
        parse_records(df.withColumnRenamed("line_id", "reason"), CATEGORY_FILE, "raw_text", ["reason"])


def test_neighbours_do_not_matter():
    """A record has the same reason in a clean block, beside bad records, and alone."""
    spec = RecordSpec((FieldRule("n", "long", must=DIGITS), FieldRule("name", blank_ok=False)))
    odd = ["7,\u00a0", "7,\u3000 ", "7,\x1f", "7,\u200b", "7,x", "7,"]
    for block in (odd, odd + ["1,a"] * 50, odd + ["1"] * 50, odd + ['"'] * 50 + ["1,a"] * 50):
        told = {}
        for at, cols, diagnoses in BlockParser(spec).parse(pa.array(block, pa.string())):
            told |= {int(k): None if cols is not None else diagnoses[i][0] for i, k in enumerate(at)}
        assert [told[k] for k in range(6)] == ["value", "value", "value", None, None, "value"], block[6:7]


def test_all_files_in_one_pass(spark):
    rows = [(i, "products.csv", t) for i, (t, _) in enumerate(CASES)] + [(100, "categories.csv", "4,Fish,x"), (101, "categories.csv", "4,Fish"), (102, "other.csv", "4,Fish,x"), (103, None, "4,Fish,x"), (104, "categories.csv", None)]
    df = spark.createDataFrame([*rows, rows[2]], "line_id int, file_name string, raw_text string")
    specs = {"products.csv": PRODUCT_FILE, "categories.csv": CATEGORY_FILE}
    got = sorted((r.line_id, r.reason) for r in failed_records(df, specs, "file_name", "raw_text", ["line_id"]).collect())
    want = [(i, r) for i, (_, r) in enumerate(CASES) if r] + [(2, "quoting"), (101, "columns"), (102, "file"), (103, "file"), (104, "columns")]
    assert got == sorted(want)
    assert failed_records(df.limit(0), specs, "file_name", "raw_text", ["line_id"]).count() == 0
