"""Experiments with a model: how its replies vary with the temperature, and how it stands many calls at once."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.operators import analytics, providers
from texmill.sources.scratch import stored


def temperature_experiment(spark: SparkSession, provider: providers.Provider, prompt: str, temperatures: list[float], repeats: int = 10, tries: int = 1) -> dict[str, DataFrame]:
    """Tables responses (temperature, n, text, error), metrics by temperature, and effect.

    One prompt is asked `repeats` times at every temperature, one call after the other. Temperatures and repeats are
    an experiment's few dozen calls.
    """
    asked = F.array(F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content")))
    responses = None
    for t in temperatures:
        at = dataclasses.replace(provider, temperature=t) if any(f.name == "temperature" for f in dataclasses.fields(provider)) else provider
        requests = spark.range(repeats).select(F.col("id").cast("string").alias("request_id"), asked.alias("messages"))
        got = providers.complete(requests, at, concurrency=1, tries=tries).select(F.lit(float(t)).alias("temperature"), F.col("request_id").cast("long").alias("n"), F.col("reply").alias("text"), "error")
        got = stored(got, "experiment")
        responses = got if responses is None else responses.unionByName(got)
    metrics = analytics.diversity(responses, "temperature").join(analytics.mean_overlap(responses, "temperature", "n"), "temperature")
    return {"responses": responses, "metrics": metrics, "effect": analytics.temperature_effect(metrics)}


def concurrency_probe(spark: SparkSession, provider: providers.Provider, prompt: str, calls: int = 100, concurrency: int = 100, per_call: float = 60.0) -> dict[str, DataFrame]:
    """Tables calls (n, ok, seconds, error) and tally (total, success, errors, mean_seconds) of one prompt asked many times at once."""
    asked = F.array(F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content")))
    requests = spark.range(calls).select(F.col("id").cast("string").alias("request_id"), asked.alias("messages"))
    got = providers.complete(requests, provider, concurrency, tries=1, per_call=per_call)
    made = stored(got.select(F.col("request_id").cast("long").alias("n"), F.col("reply").isNotNull().alias("ok"), "seconds", "error"), "probe")
    return {"calls": made, "tally": analytics.tally(made)}
