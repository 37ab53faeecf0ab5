"""Stored state: parsed documents as JSON, and result files that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
SCHEMA = "version string, doc_id string, global_placeholders array<struct<placeholder:string,original:string>>, chunks array<struct<id:string,content:string,latex_wrapper:string,context:string>>, all_valid_placeholders array<string>"


def parser_state(parsed: DataFrame) -> DataFrame:
    """doc_id, state (JSON): a document's placeholders and chunks in order, and its sorted valid placeholders."""
    by = lambda kind, x: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", x.alias("x")))))
    chunk = F.struct("id", "content", F.col("wrapper").alias("latex_wrapper"), "context")
    per = parsed.groupBy("doc_id").agg(by("placeholder", F.struct(F.col("id").alias("placeholder"), F.col("content").alias("original"))).alias("p"), by("chunk", chunk).alias("c"))
    names = F.array_sort(F.array_distinct(F.col("p.x.placeholder")))
    return per.select("doc_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), "doc_id", F.col("p.x").alias("global_placeholders"), F.col("c.x").alias("chunks"), names.alias("all_valid_placeholders"))).alias("state"))


def save_parser_state(parsed: DataFrame, folder: str) -> None:
    parser_state(parsed).select(F.col("state").alias("value")).write.mode("overwrite").text(folder)


def load_valid_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, placeholder of every stored document."""
    return spark.read.schema(SCHEMA).json(folder).select("doc_id", F.explode("all_valid_placeholders").alias("placeholder"))


def append_results(rows: DataFrame, folder: str, key: str) -> DataFrame:
    """Append rows as JSON and give the counts over all that the folder holds: total, ok, failed, distinct keys."""
    rows.write.mode("append").json(folder)
    held = rows.sparkSession.read.schema(rows.schema).json(folder)
    return held.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct(key).alias("keys"))


def save_report(report: DataFrame, folder: str) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(folder)
