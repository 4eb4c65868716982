"""Queries of the data-quality operators of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import badrows, orphans, skew, units
from weftline.session import read_table

#: A product is heavy if it holds at least one in so many rows.
HEAVY_PARTS = 40


def p1_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = skew.product_totals(read_table(spark, sf_dir, "order_items"))
    return got.select("product_id", "n_rows", F.round("total_quantity", 4).alias("total_quantity"), F.round("revenue", 4).alias("revenue"))


def p1_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of very large and of very small values of every product, brought back to their scale at the end."""
    items = read_table(spark, sf_dir, "order_items")
    got = skew.tree_aggregate(items, ["product_id"], [skew.Measure("large", "sum", F.col("quantity") * 1e23), skew.Measure("small", "sum", F.col("unit_price") * 1e-7)])
    return got.select("product_id", F.round(F.col("large") / 1e23, 4).alias("large"), F.round(F.col("small") / 1e-7, 4).alias("small"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(read_table(spark, sf_dir, "order_items"), "product_id", HEAVY_PARTS).select("product_id")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    """Known units, declared and estimated units of the feeds."""
    known = units.known_units(read_table(spark, sf_dir, "measure_units"))
    estimated = units.price_sources(
        read_table(spark, sf_dir, "ds2_products"), "feed", "unitprice", "productname",
        read_table(spark, sf_dir, "ds1_products"), "list_price", "product_name", "EUR", known,
    )
    return known, units.declared_sources(read_table(spark, sf_dir, "price_feeds"), "feed", "price_unit"), estimated


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of sources decides the unit of every feed's bare prices; a feed that it leaves open has the unit declared."""
    known, declared, estimated = _sources(spark, sf_dir)
    return units.common_units(read_table(spark, sf_dir, "ds2_products"), "productid", "quantityperunit", "unitprice", "feed", known, units.source_units(estimated, declared))


def p3_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found without any declaration: what differs from the units declared."""
    known, declared, estimated = _sources(spark, sf_dir)
    ds2 = read_table(spark, sf_dir, "ds2_products")
    alone = units.common_units(ds2, "productid", "quantityperunit", "unitprice", "feed", known, estimated)
    said = units.common_units(ds2, "productid", "quantityperunit", "unitprice", "feed", known, declared.withColumnRenamed("declared", "unit"))
    return alone.exceptAll(said).unionByName(said.exceptAll(alone))


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph of sources says of every feed's bare prices, beside what the feed declares."""
    _, declared, estimated = _sources(spark, sf_dir)
    got = declared.join(estimated, "source", "full")
    return got.select(F.col("source").alias("feed"), F.col("declared").alias("declared_unit"), F.col("unit").alias("estimated_unit"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("distance").alias("log_distance"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[list, list]:
    t = {n: read_table(spark, sf_dir, n) for n in ("order_items", "ds1_products", "ds2_products", "categories")}
    return (
        [orphans.ParentTable("ds1_products", t["ds1_products"], "id", "loaded_at", "deleted_at"), orphans.ParentTable("categories", t["categories"], "categoryid", "loaded_at", "deleted_at")],
        [orphans.Reference("order_items", t["order_items"], "id", "product_id", "ds1_products", "loaded_at", "ordered_at"), orphans.Reference("ds2_products", t["ds2_products"], "productid", "categoryid", "categories", "loaded_at", "loaded_at")],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_rows(*_references(spark, sf_dir)).select("src_table", "row_id", "kind").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans_by_period(*_references(spark, sf_dir))


def p5_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.missing_by_period(*_references(spark, sf_dir))


_R = badrows.FieldRule
PRODUCT_FILE = badrows.RecordSpec((
    _R("ProductID", "long", must=badrows.DIGITS), _R("ProductName", blank_ok=False), _R("CategoryID", "int", must=badrows.DIGITS),
    _R("QuantityPerUnit", must="[0-9]", never=badrows.CONTROL, blank_ok=False), _R("UnitPrice", "double", must=r"\A[0-9]+(?:\.[0-9]+)?\z"),
    _R("UnitsInStock", "int", must=badrows.DIGITS), _R("UnitsOnOrder", "int", must=r"\A[0-9]*\z"), _R("ReorderLevel", "int", must=r"\A[0-9]*\z"),
    _R("Discontinued", must=r"\A(?:WAHR|FALSCH)\z"),
))
CATEGORY_FILE = badrows.RecordSpec((
    _R("CategoryID", "int", must=badrows.DIGITS), _R("CategoryName", blank_ok=False), _R("Description", never=badrows.CONTROL_BUT_LF_TAB, blank_ok=False),
))
FILES = {"products.csv": PRODUCT_FILE, "categories.csv": CATEGORY_FILE}


def _records(spark: SparkSession, sf_dir: str, file: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "raw_lines").filter(F.col("file_name") == file)
    return badrows.parse_records(raw, FILES[file], "raw_text", ["line_id", "file_name", "line_no"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't load, of both files in one pass; those of any other file have the reason ``file``."""
    return badrows.failed_records(read_table(spark, sf_dir, "raw_lines"), FILES, "file_name", "raw_text", ["line_id"]).select("line_id", "reason")


def p6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of products.csv, as typed columns."""
    return _records(spark, sf_dir, "products.csv").filter("reason is null").select("line_id", *PRODUCT_FILE.names)


def p6_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "categories.csv").filter("reason is null").select("line_id", *CATEGORY_FILE.names)


QUERIES = {f.__name__: f for f in (p1_products, p1_found, p1_extremes, p3_found, p3_undeclared, p3_sources, p5_found, p5_report, p5_missing, p6_found, p6_products, p6_categories)}

_F = r'("(?:[^"]|"")*"|[^",]*)'
_ORPHANS = """
WITH r AS (
  SELECT 'order_items' AS src_table, o.id AS row_id, strftime(o.ordered_at, '%Y-%m') AS period, CAST(o.product_id AS VARCHAR) AS key, p.id IS NULL AS gone,
         coalesce(p.loaded_at > o.loaded_at, FALSE) AS late, coalesce(p.deleted_at <= o.ordered_at, FALSE) AS dead
  FROM order_items o LEFT JOIN ds1_products p ON p.id = o.product_id WHERE o.product_id IS NOT NULL
  UNION ALL
  SELECT 'ds2_products', d.productid, strftime(d.loaded_at, '%Y-%m'), CAST(d.categoryid AS VARCHAR), c.categoryid IS NULL,
         coalesce(c.loaded_at > d.loaded_at, FALSE), coalesce(c.deleted_at <= d.loaded_at, FALSE)
  FROM ds2_products d LEFT JOIN categories c ON c.categoryid = d.categoryid WHERE d.categoryid IS NOT NULL),
k AS (SELECT src_table, row_id, period, key, CASE WHEN gone THEN 'missing' WHEN late THEN 'late' WHEN dead THEN 'deleted' END AS kind FROM r)
"""


def _field(n: int, k: int) -> str:
    """SQL for the k-th of n fields of a well-quoted record, unquoted."""
    pattern = "^" + ",".join([_F] * n) + "$"
    raw = f"regexp_extract(raw_text, '{pattern}', {k})"
    return f"(CASE WHEN starts_with({raw}, '\"') THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END)"


_BLANKS = badrows.BLANK.removeprefix("\\A").removesuffix("\\z")
_QUOTED = f"regexp_full_match(raw_text, '{_F}(,{_F})*')"
_PRODUCT_COLS = ", ".join(f"{_field(9, i + 1)} AS f{i}" for i in range(9))
_CATEGORY_COLS = ", ".join(f"{_field(3, i + 1)} AS f{i}" for i in range(3))
_PARSED = f"""
WITH p AS (SELECT line_id, {_QUOTED} AS q, regexp_full_match(raw_text, '{",".join([_F] * 9)}') AS n, {_PRODUCT_COLS} FROM raw_lines WHERE file_name = 'products.csv'),
c AS (SELECT line_id, {_QUOTED} AS q, regexp_full_match(raw_text, '{",".join([_F] * 3)}') AS n, {_CATEGORY_COLS} FROM raw_lines WHERE file_name = 'categories.csv'),
pr AS (SELECT *, CASE WHEN NOT q THEN 'quoting' WHEN NOT n THEN 'columns' WHEN NOT (regexp_full_match(f0, '[0-9]+') AND regexp_full_match(f2, '[0-9]+') AND regexp_full_match(f5, '[0-9]+')
   AND regexp_full_match(f4, '[0-9]+([.][0-9]+)?') AND regexp_full_match(f6, '[0-9]*') AND regexp_full_match(f7, '[0-9]*') AND NOT regexp_full_match(f1, '{_BLANKS}') AND f8 IN ('WAHR', 'FALSCH')
   AND NOT regexp_full_match(f3, '{_BLANKS}') AND regexp_matches(f3, '[0-9]') AND NOT regexp_matches(f3, '[\\x00-\\x1f\\x7f-\\x9f\\x{{fffd}}]')) THEN 'value' END AS reason FROM p),
cr AS (SELECT *, CASE WHEN NOT q THEN 'quoting' WHEN NOT n THEN 'columns' WHEN NOT (regexp_full_match(f0, '[0-9]+') AND NOT regexp_full_match(f1, '{_BLANKS}') AND NOT regexp_full_match(f2, '{_BLANKS}')
   AND NOT regexp_matches(f2, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{{fffd}}]')) THEN 'value' END AS reason FROM c)
"""

SQL = {
    "p1_products": """
SELECT product_id, count(*) AS n_rows, round(fsum(quantity), 4) AS total_quantity, round(fsum(quantity * unit_price), 4) AS revenue
FROM order_items GROUP BY product_id""",
    "p1_extremes": """
SELECT product_id, round(fsum(quantity * 1e23) / 1e23, 4) AS large, round(fsum(unit_price * 1e-7) / 1e-7, 4) AS small FROM order_items GROUP BY product_id""",
    "p1_found": "SELECT product_id FROM order_items GROUP BY product_id HAVING product_id IS NOT NULL AND count(*) * 40 >= (SELECT count(*) FROM order_items)",
    "p3_undeclared": "SELECT productid, unitprice AS field_name, unitprice AS base_unit, CAST(0 AS BIGINT) AS amount FROM ds2_products WHERE false",
    "p5_found": _ORPHANS + "SELECT DISTINCT src_table, row_id, kind FROM k WHERE kind IS NOT NULL",
    "p5_report": _ORPHANS + """, u AS (SELECT DISTINCT src_table, row_id, kind, period, key FROM k WHERE kind IS NOT NULL)
SELECT src_table, period, kind, count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM u GROUP BY src_table, period, kind""",
    "p5_missing": _ORPHANS + "SELECT src_table, period, count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM k WHERE kind = 'missing' GROUP BY src_table, period",
    "p6_found": _PARSED + "SELECT line_id, reason FROM pr WHERE reason IS NOT NULL UNION ALL SELECT line_id, reason FROM cr WHERE reason IS NOT NULL UNION ALL SELECT line_id, 'file' FROM raw_lines WHERE file_name IS NULL OR file_name NOT IN ('products.csv', 'categories.csv')",
    "p6_products": _PARSED + """SELECT line_id, CAST(f0 AS BIGINT) AS "ProductID", f1 AS "ProductName", CAST(f2 AS INTEGER) AS "CategoryID", f3 AS "QuantityPerUnit", CAST(f4 AS DOUBLE) AS "UnitPrice",
CAST(f5 AS INTEGER) AS "UnitsInStock", CAST(nullif(f6, '') AS INTEGER) AS "UnitsOnOrder", CAST(nullif(f7, '') AS INTEGER) AS "ReorderLevel", f8 AS "Discontinued" FROM pr WHERE reason IS NULL""",
    "p6_categories": _PARSED + """SELECT line_id, CAST(f0 AS INTEGER) AS "CategoryID", f1 AS "CategoryName", f2 AS "Description" FROM cr WHERE reason IS NULL""",
}
