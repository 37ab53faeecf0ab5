"""Tables on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, label: str, base: str | None = None) -> str:
    """A path that no one has, under base or the folder in spark.checkpoint.dir.

    Only a session on one machine may lack that setting (as in tests); a local folder stands in there.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/texmill-work"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """df, written once and read back: nothing before it runs again, and a lost executor costs a task."""
    path = fresh_path(df.sparkSession, label, base)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
