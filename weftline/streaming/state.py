"""Totals per key over the last stretch of event time, kept up to date with every batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import ship_package


def sliding_totals(stream: DataFrame, key: str, time: str, value: str, age_seconds: float, watermark: str = "0 seconds") -> DataFrame:
    """``(key, upto, total, n)`` per key and batch: sum and number of the values younger than ``age_seconds`` at the key's latest time.

    Values that grow too old are taken off again.  The state of a key is what
    lies within the age; rows with a null key, time or value are left out, rows
    older than the age at arrival change nothing.
    """
    ship_package(stream.sparkSession)
    d = stream.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{time}`").cast("timestamp").alias("time"), F.col(f"`{value}`").cast("double").alias("value")).dropna()
    micros = int(age_seconds * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        kept: list[tuple[int, float]] = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for f in frames:
            kept += zip((f["time"].astype("datetime64[us]").astype("int64")).tolist(), f["value"].tolist())
        last = max(t for t, _ in kept)
        kept = sorted(x for x in kept if x[0] > last - micros)
        state.update(([t for t, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({"key": [k[0]], "upto": [pd.Timestamp(last, unit="us")], "total": [float(sum(v for _, v in kept))], "n": [len(kept)]})

    keyed = (d.withWatermark("time", watermark) if d.isStreaming else d).groupBy("key")
    return keyed.applyInPandasWithState(step, "key string, upto timestamp, total double, n long", "times array<bigint>, vals array<double>", "update", "NoTimeout")
