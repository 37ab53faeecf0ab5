"""Placeholders that a translation lost, invented or misspelt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texmill.functions.text import PLACEHOLDER, strip

NEAR = 2


def placeholders(text: Column) -> Column:
    """Distinct placeholders of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def spurious(pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, bad: placeholders of the translation that its own source lacks."""
    return pairs.select(key, F.explode(F.array_except(placeholders(F.col("translation")), placeholders(F.col("source")))).alias("bad"))


def verdicts(pairs: DataFrame, valid: DataFrame, key: str = "chunk_id", near: int = NEAR) -> DataFrame:
    """key, bad, type, fixed_to of every spurious placeholder.

    One that is valid elsewhere is an invention here and goes. Another becomes the source's nearest placeholder, by
    edit distance and then by name, if that is at most `near` away; else it goes.
    """
    bad = spurious(pairs, key)
    known = valid.select(F.col("placeholder").alias("bad")).distinct().withColumn("is_valid", F.lit(True))
    own = pairs.select(key, F.explode_outer(placeholders(F.col("source"))).alias("own"))
    distance = F.levenshtein("bad", "own")
    nearest = bad.join(own, key).groupBy(key, "bad").agg(F.min(F.when(F.col("own").isNotNull(), F.struct(distance.alias("d"), F.col("own").alias("own")))).alias("best"))
    judged = nearest.join(known, "bad", "left")
    typo = F.col("is_valid").isNull() & (F.col("best.d") <= near)
    return judged.select(key, "bad", F.when(typo, "typo_fixed").otherwise("hallucination").alias("type"), F.when(typo, F.col("best.own")).alias("fixed_to"))


def repaired(pairs: DataFrame, valid: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, source, translation (repaired; the source where nothing is left), and issues, of every pair."""
    fixes = verdicts(pairs, valid, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bad", "type", "fixed_to"))).alias("fixes"))
    joined = pairs.join(fixes, key, "left").withColumn("fixes", F.coalesce("fixes", F.expr("cast(array() as array<struct<bad:string,type:string,fixed_to:string>>)")))
    text = F.aggregate("fixes", F.col("translation"), lambda t, f: F.replace(t, f["bad"], F.coalesce(f["fixed_to"], F.lit(""))))
    fixed = joined.withColumn("fixed", text)
    missing = F.transform(F.array_except(placeholders(F.col("source")), placeholders(F.col("fixed"))), lambda p: F.struct(p.alias("bad"), F.lit("missing").alias("type"), F.lit(None).cast("string").alias("fixed_to")))
    return fixed.select(key, "source", F.when(strip(F.col("fixed")) == "", F.col("source")).otherwise(F.col("fixed")).alias("translation"), F.concat("fixes", missing).alias("issues"))


def missing(pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    return pairs.select(key, F.explode(F.array_except(placeholders(F.col("source")), placeholders(F.col("translation")))).alias("missing"))


def orphans(chunks: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks that no text refers to (protected ones aside)."""
    return chunks.where("context <> 'protected'").join(references.select(key, "chunk_id").distinct(), [key, "chunk_id"], "left_anti")


def numbered_tokens(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans with n: one counter a document over all kinds, by pass and then place."""
    return spans.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pass", "pos")).cast("long"))
