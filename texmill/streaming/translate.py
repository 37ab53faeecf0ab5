"""An extension: chunks that arrive as files are translated batch by batch; the state folder makes each paid once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from texmill.plans.translate import Options, translate_chunks

CHUNKS = "doc_id string, ord int, chunk_id string, content string"


def translate_stream(spark: SparkSession, source: str, state: str, checkpoint: str, terms: DataFrame | None = None, options: Options | None = None):
    """Start a query that takes Parquet files of chunks under source and appends results under state."""
    options = replace(options or Options(), state=state)

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            translate_chunks(batch.dropDuplicates(["chunk_id"]), terms, None, options)

    return spark.readStream.schema(CHUNKS).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
