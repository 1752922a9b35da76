"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

HOT = 1000  # keys that a lookup broadcasts, at most


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all tasks run on this machine (tests), a folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """The rows that have their key in table, with its other columns; keys are never null, and unique in table.

    weight: table's column of how many rows each key has.  Keys with over one HOT-th of them, HOT
    at most, are broadcast and their rows stay where they are; the others are shuffled.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * HOT > total).drop(weight))
    cold = table.where(F.col(weight) * HOT <= total).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it, so that it is none of taken, whatever the case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def local_file(path: str) -> str:
    """A vocabulary file in a task: path where it exists, else the file of that name among this machine's public tokenizers."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(os.path.basename(path)))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most so many rows at a time to Python, so that the texts of a batch stay small on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(setting))
    spark.conf.set(setting, min(before, rows) if before > 0 else rows)  # 0 or less: no limit
    try:
        yield
    finally:
        spark.conf.set(setting, before)


_KEPT: dict[str, dict] = {}  # what this worker keeps from task to task, by operator


def kept_by(operator: str) -> dict:
    """What this worker keeps for an operator; what it keeps for others is dropped, and its memory given back, as jobs run one operator after the other."""
    dropped = [kept for name, kept in _KEPT.items() if name != operator and kept]
    for kept in dropped:
        kept.clear()
    if dropped:
        give_back()
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Free memory that this worker's allocators hold goes back to the system, where the C library can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Sent:
    """A broadcast with a number by which workers know it again, so that what they build from it is kept from task to task."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value
