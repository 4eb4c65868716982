"""Queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import cooccur, leakage, matching, packing, truncation
from weftline.operators import units
from weftline.session import materialise, read_table

#: G2 of one degree of freedom at a probability of 0.001.
SIGNIFICANT = 10.828


def _sides(spark: SparkSession, sf_dir: str) -> tuple[matching.Side, matching.Side]:
    """Both product tables; prices of the second are brought to EUR."""
    known = units.known_units(read_table(spark, sf_dir, "measure_units"))
    feeds = units.declared_sources(read_table(spark, sf_dir, "price_feeds"), "feed", "price_unit").withColumnRenamed("source", "feed")

    @F.pandas_udf("double")
    def euros(text: pd.Series, unit: pd.Series) -> pd.Series:
        got = units.each_text_once(lambda t, u: units.convert_price(known, t, u), text, unit)
        return pd.Series([None if g is None else g[1] / 100 for g in got], dtype=float)

    ds2 = read_table(spark, sf_dir, "ds2_products").join(feeds, "feed", "left").select("productid", "productname", "categoryid", euros("unitprice", "declared").alias("eur"))
    return (
        matching.Side(read_table(spark, sf_dir, "ds1_products"), "id", "product_name", "list_price", "category"),
        matching.Side(ds2, "productid", "productname", "eur", "categoryid"),
    )


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matching.match_entities(*_sides(spark, sf_dir))
    return got.select(F.col("left_id").alias("ds1_id"), F.col("right_id").alias("ds2_productid"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("ds1_id", "ds2_productid")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    return _matches(spark, sf_dir)


def p2_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that can't be: a second one of a ds2 product, an id of neither table, a confidence out of bounds. There are none."""
    got = _matches(spark, sf_dir)
    twice = got.groupBy("ds2_productid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ds2_productid", F.lit("twice").alias("why"))
    lost = got.join(read_table(spark, sf_dir, "ds1_products").select(F.col("id").alias("ds1_id")), "ds1_id", "left_anti").select("ds2_productid", F.lit("no ds1").alias("why"))
    lost = lost.unionByName(got.join(read_table(spark, sf_dir, "ds2_products").select(F.col("productid").alias("ds2_productid")), "ds2_productid", "left_anti").select("ds2_productid", F.lit("no ds2").alias("why")))
    return twice.unionByName(lost).unionByName(got.filter(~F.col("confidence").between(0.5, 1)).select("ds2_productid", F.lit("confidence").alias("why")))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ds1 product with the one that stands for all of its name."""
    return matching.left_members(_sides(spark, sf_dir)[0]).select(F.col("left_id").alias("ds1_id"), "same_as")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cooccur.cooccurrence(read_table(spark, sf_dir, "order_items"), "order_id", "product_id", min_count=12, min_lift=4)
    return got.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of products that meet in two orders or more and significantly more often than chance."""
    got = cooccur.cooccurrence(read_table(spark, sf_dir, "order_items"), "order_id", "product_id", min_count=2)
    got = got.filter((F.col("lift") > 1) & (F.round("llr", 4) >= SIGNIFICANT))
    return got.select(
        F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), F.col("k").alias("orders_both"), F.col("c_a").alias("orders_a"), F.col("c_b").alias("orders_b"),
        F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr"),
    )


def p4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of products that meet in an order, with how far that exceeds chance; nothing is left out."""
    got = cooccur.cooccurrence(read_table(spark, sf_dir, "order_items"), "order_id", "product_id")
    return got.select(
        F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), F.col("k").alias("orders_both"), F.col("c_a").alias("orders_a"), F.col("c_b").alias("orders_b"),
        F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr"),
    )


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that are overfull or not filled without holes, and texts whose pieces don't make up the whole. There are none."""
    got = materialise(p7_packed(spark, sf_dir), "packed")
    per = got.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_offset") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("k"), F.max("place").alias("last"))
    bad = per.filter((F.col("n") > packing.CAPACITY) | (F.col("end") != F.col("n")) | (F.col("last") != F.col("k") - 1)).select(F.lit("container").alias("what"), F.col("container_id").alias("id"))
    texts = got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.max("piece").alias("last"), F.count(F.lit(1)).alias("k"))
    split = texts.filter((F.col("n") != F.col("end")) | (F.col("last") != F.col("k") - 1)).select(F.lit("text").alias("what"), F.col("doc_id").alias("id"))
    lost = read_table(spark, sf_dir, "documents").select("doc_id").join(texts.select("doc_id"), "doc_id", "left_anti").select(F.lit("lost").alias("what"), F.col("doc_id").alias("id"))
    return bad.unionByName(split).unionByName(lost)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is packed once, in one piece unless it is longer than a container."""
    got = p7_packed(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"))
    return got.select("doc_id", (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))).alias("least_pieces"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every test item, in how many documents it leaks and how much of it at most; items that don't leak too."""
    leaks = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("most_words"))
    items = read_table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return items.join(leaks, "item_id", "left").fillna(0, ["n_docs", "most_words"])


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item word for word, as p8_found has them."""
    leaks = _leaks(spark, sf_dir).select("doc_id", "item_id")
    texts, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "eval_items").select("item_id", "item_text")
    return leaks.join(texts, "doc_id").join(items, "item_id").filter(F.contains("text", "item_text")).select("doc_id", "item_id")


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).filter("p_cut >= 0.5").select("doc_id").distinct()


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts, and how often at a limit."""
    return truncation.source_report(_cuts(spark, sf_dir))


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every source that p9_sources speaks of: all that aren't empty."""
    return p9_sources(spark, sf_dir).select("source", "n_texts")


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p2_violations, p2_members, p4_found, p4_pairs, p4_all, p7_packed, p7_violations, p7_pieces, p8_found, p8_items, p8_verbatim, p9_found, p9_sources, p9_counts)}

_PAIRS = """
WITH b AS (SELECT DISTINCT order_id, product_id FROM order_items WHERE order_id IS NOT NULL AND product_id IS NOT NULL),
n AS (SELECT count(DISTINCT order_id) AS n FROM b),
c AS (SELECT product_id, count(*) AS c FROM b GROUP BY product_id),
k AS (SELECT x.product_id AS product_a, y.product_id AS product_b, count(*) AS k FROM b x JOIN b y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2),
j AS (SELECT product_a, product_b, k, ca.c AS a, cb.c AS b, n FROM k JOIN c ca ON ca.product_id = product_a JOIN c cb ON cb.product_id = product_b CROSS JOIN n)
"""
_T = "(CASE WHEN ({0}) > 0 THEN ({0}) * ln({0}) ELSE 0.0 END)"
_LLR = "greatest(0.0, 2 * (" + " + ".join(_T.format(f"CAST({x} AS DOUBLE)") for x in ("k", "(a - k)", "(b - k)", "(n - a - b + k)", "n"))
_LLR += "".join(" - " + _T.format(f"CAST({x} AS DOUBLE)") for x in ("a", "(n - a)", "b", "(n - b)")) + "))"

SQL = {
    "p2_violations": "SELECT productid AS ds2_productid, '' AS why FROM ds2_products WHERE false",
    "p7_violations": "SELECT '' AS what, doc_id AS id FROM documents WHERE false",
    "p7_pieces": "SELECT doc_id, TRUE AS least_pieces FROM documents",
    "p8_verbatim": "SELECT doc_id, item_id FROM documents JOIN eval_items ON contains(text, item_text) WHERE len(regexp_extract_all(item_text, '[a-zA-Z0-9]+')) >= 20",
    "p9_counts": "SELECT source, count(*) AS n_texts FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY source",
    "p4_found": _PAIRS + "SELECT product_a, product_b FROM j WHERE k >= 12 AND k * n >= 4 * a * b",
    "p4_all": _PAIRS
    + f"""SELECT product_a, product_b, k AS orders_both, a AS orders_a, b AS orders_b, round(CAST(k AS DOUBLE) * n / (CAST(a AS DOUBLE) * b), 4) AS lift, round({_LLR}, 4) AS llr FROM j""",
    "p4_pairs": _PAIRS
    + f""", s AS (SELECT *, round({_LLR}, 4) AS llr FROM j)
SELECT product_a, product_b, k AS orders_both, a AS orders_a, b AS orders_b, round(CAST(k AS DOUBLE) * n / (CAST(a AS DOUBLE) * b), 4) AS lift, llr
FROM s WHERE k >= 2 AND CAST(k AS DOUBLE) * n > CAST(a AS DOUBLE) * b AND llr >= {SIGNIFICANT}""",
}
