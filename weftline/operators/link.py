"""Links: for each row the id of the row of another table with equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.operators.ids import ID, with_ids
from weftline.session import materialise

MISSING = -1


def _same_types(facts: DataFrame, target: DataFrame, keys: list[str]) -> None:
    """Equality is strict on types, so values of another type would never be found: refuse them."""
    for i, k in enumerate(keys):
        a, b = facts.schema[f"__v{i}"].dataType, target.schema[k].dataType
        if a != b:
            raise EngineError(ErrorCode.DEFINITION, f"values of type {a.simpleString()} are compared with key {k} of type {b.simpleString()}", "cast them to one type")


def link(facts: DataFrame, values: list[Column], target: DataFrame, keys: list[str], name: str, bring: dict[str, str] | None = None, unique: bool = False, target_id: str = ID) -> DataFrame:
    """``facts`` with column ``name``: the lowest id of the target rows whose keys equal the values, else -1.

    Null equals null.  Unless its keys are known to be ``unique``, the target is
    brought to one row per key first, so the join never multiplies facts.  The
    join also yields the columns named in ``bring`` (new name -> column of the
    target), null where the link is missing.
    """
    if len(values) != len(keys) or not keys:
        raise EngineError(ErrorCode.DEFINITION, "as many values as keys are needed")
    bring = bring or {}
    ks = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    along = [F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(bring.values())]
    if unique:
        index = target.select(*ks, F.col(target_id).alias("__to"), *along)
    else:
        first = [F.min(target_id).alias("__to")] if not bring else [F.min_by(F.struct(F.col(target_id).alias("__to"), *along), target_id).alias("__r")]
        index = target.groupBy(*ks).agg(*first)
        if bring:
            index = index.select(*(f"__k{i}" for i in range(len(keys))), "__r.*")
    probe = facts.withColumns({f"__v{i}": v for i, v in enumerate(values)})
    _same_types(probe, target, keys)
    cond = F.lit(True)
    for i in range(len(keys)):
        cond = cond & F.col(f"__v{i}").eqNullSafe(F.col(f"__k{i}"))
    joined = probe.join(index, cond, "left")
    kept = [F.col(f"`{c}`") for c in facts.columns if c != name and c not in bring]
    return joined.select(*kept, F.coalesce("__to", F.lit(MISSING)).cast("long").alias(name), *(F.col(f"__b{i}").alias(b) for i, b in enumerate(bring)))


def project(facts: DataFrame, values: list[Column], keys: list[str], order: str = ID, keep: Callable[[DataFrame], DataFrame] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """The target table of a projection: the distinct tuples of values, with ids in order of first appearance.

    ``keep`` restricts the tuples that may be added, before any of them is
    numbered.  Rows of ``existing`` keep their ids and are not added again; ids
    go on after them.
    """
    first = facts.select(*(v.alias(k) for v, k in zip(values, keys)), F.col(order).alias("__first")).groupBy(*(f"`{k}`" for k in keys)).agg(F.min("__first").alias("__first"))
    if keep is not None:
        first = keep(first)
    if existing is None:
        return with_ids(materialise(first), ["__first"]).select(ID, *(f"`{k}`" for k in keys))
    old = existing.select(*(F.col(f"`{k}`").alias(f"__old_{k}") for k in keys))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`__old_{k}`"))
    new = first.join(old, cond, "left_anti")
    after = F.coalesce(existing.agg((F.max(ID) + 1).alias("n")).scalar(), F.lit(0))
    added = with_ids(materialise(new), ["__first"], start=after).select(ID, *(f"`{k}`" for k in keys))
    return existing.unionByName(added, allowMissingColumns=True)
