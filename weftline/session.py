"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver runs: it goes to them with the session's files, once."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, place = tempfile.mkstemp(prefix="weftline-", suffix=".zip")  # the driver serves it to the executors
    os.close(handle)
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(place)
    atexit.register(lambda: os.path.exists(place) and os.remove(place))
    sc._weftline_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only where
    that is unset, and only in local mode, a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    sc.setCheckpointDir(folder)


def _delete(spark: SparkSession, place: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        if "://" not in place or place.startswith("file:"):
            shutil.rmtree(place.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


#: Folders made by ``scratch_folder`` that still exist.
scratch_made: list[str] = []


def delete_scratch(spark: SparkSession, places: list[str]) -> None:
    for place in places:
        _delete(spark, place)
        if place in scratch_made:
            scratch_made.remove(place)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder; it is deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/weftline-{purpose}-{uuid.uuid4()}"
    if not scratch_made:
        atexit.register(lambda: delete_scratch(spark, list(scratch_made)))
    scratch_made.append(place)
    return place


def materialise(df: DataFrame, purpose: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, with a short plan, known size and column pruning.

    What Parquet can't hold (columns without a type, two of one name) is
    checkpointed instead.
    """
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    if len({c.lower() for c in df.columns}) < len(df.columns) or any("void" in k or "interval" in k for k in kinds):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    place = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Estimates from here on mean that the optimizer knows nothing.
UNKNOWN_BYTES = 1 << 55


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan, without running it; None where it has none."""
    got = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if got >= UNKNOWN_BYTES else got


def parts_for(df: DataFrame, bytes_per_part: int) -> int:
    """Into how many parts of a size a table falls; without an estimate, the session's number of shuffle partitions."""
    size = plan_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / bytes_per_part))


def chunk_count(df: DataFrame) -> int:
    """About how many input splits a scan of ``df`` has (from statistics, nothing runs)."""
    raw = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = raw.rstrip("b")
    return parts_for(df, int(digits[:-1]) * unit[digits[-1]] if digits and digits[-1] in unit else int(digits))
