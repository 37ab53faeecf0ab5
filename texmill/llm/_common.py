"""Shared helpers of the corpus operators: table reading, shared scratch space, Arrow glue."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Only a session on one machine may lack that setting (as in tests); a local folder stands in there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/texmill-checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Like checkpoints, such tables stay until the folder is cleared.
    """
    return _write(df, scratch(df.sparkSession, label))


class Workspace:
    """Tables of one computation in a folder of its own, deleted once its result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, scratch(spark, label), 0

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        return _write(df, f"{self.folder}/{self.n:03}-{label}")

    def drop(self, first: int, last: int) -> None:
        """Delete the tables after the first so many up to number last."""
        fs, folder = self._at()
        for status in fs.listStatus(folder):
            if first < int(status.getPath().getName()[:3]) <= last:
                fs.delete(status.getPath(), True)

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result beside the folder, delete the folder, and read the result back."""
        out = keep(df, label)
        fs, folder = self._at()
        fs.delete(folder, True)
        return out

    def _at(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder


_BATCH_BYTES, _DEFAULT_BYTES, _OUR_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def _give_back() -> None:
    """Return a finished task's memory to the machine; a worker lives on and serves other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(fn, schema) with batches of some 8 MB (unless the session sets a size), since texts can be long."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) == _DEFAULT_BYTES:
        conf.set(_BATCH_BYTES, str(_OUR_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """mapInArrow function that applies fn to every batch and skips what is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := fn(batch)) is not None:
                yield out

    return run
