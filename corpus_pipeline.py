"""A corpus in stages: quality, near-duplicates, benchmark contamination, secrets, packing.

Each stage takes what the one before kept, as documents; its decisions take effect. All but the last return the
columns of documents, whatever these are called.

Defined results: an empty table goes through all stages and gives no pieces. Null and blank texts have no quality and
go in the first stage (in the others they stay: they are near no text, clean, and without secrets). Rows that agree in
id and text count as one from near_dedup on; different texts under one id go or stay each by itself; rows of a null id
are near no other and stay, and go by their text where that is contaminated. Very long texts are read whole by all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import keep, read
from texmill.llm.decontaminate import without_contaminated
from texmill.llm.near_dedup import without_duplicates
from texmill.llm.packing import pack
from texmill.llm.resampling import only_kept
from texmill.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents unlike the labelled good ones go; without labels of both kinds all with text stay."""
    return only_kept(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return without_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark go; an empty benchmark leaves all."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL can't express hashed sampling, the sketches or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
