"""All combinations of the rows of several tables, restricted by a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.operators.ids import ID, with_ids
from weftline.session import materialise


def product(tables: dict[str, DataFrame], where: Column | None = None) -> DataFrame:
    """``(_id, key...)``: one key column per table, holding row ids; the first key changes slowest.

    ``where`` is a condition over columns named ``key.column`` of all tables.  It
    filters before anything is numbered, so the optimizer turns its equal parts
    into equi-joins and pushes the parts on one table below them; only what
    survives is written down and numbered.  An empty table makes the product
    empty.
    """
    if not tables:
        raise EngineError(ErrorCode.DEFINITION, "a product needs a key column")
    sides = {k: df.select(*(F.col(f"`{c}`").alias(f"{k}.{c}") for c in df.columns)) for k, df in tables.items()}
    out = None
    for side in sides.values():
        out = side if out is None else out.crossJoin(side)
    if where is not None:
        out = out.filter(where)
    keys = materialise(out.select(*(F.col(f"`{k}.{ID}`").alias(k) for k in sides)))
    return with_ids(keys, list(sides), unique=True).select(ID, *sides)
