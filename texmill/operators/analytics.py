"""Aggregates over calls, replies, papers and experiments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texmill.functions.text import member_class


def nth_smallest(rows: DataFrame, column: str, place, slots: int = 4096, few: int = 10_000) -> DataFrame:
    """One row, value: the place(n)-th smallest of the n values; no row without values.

    Counts per slot of the value range give the slot that holds it, whose values are counted in slots again, until
    they are few; so neither outliers nor ties gather rows in one task. At most slots or few rows reach the driver.
    """
    x = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    out = lambda *values: rows.sparkSession.createDataFrame([(v,) for v in values], "value double")
    if not n:
        return out()
    nth = place(n)
    while n > few and low < high:
        inside, width = x.where((F.col("x") >= low) & (F.col("x") <= high)), (high - low) / slots
        if low + width == low:
            break
        slot = F.least(F.floor((F.col("x") - low) / width), F.lit(slots - 1))
        for r in sorted(inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r.slot):
            if nth <= r.c:
                low, high, n = r.lo, r.hi, r.c
                break
            nth -= r.c
    if low == high:
        return out(low)
    values = x.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("c")).collect()  # few, or neighbouring doubles
    for r in sorted(values, key=lambda r: r.x):
        if nth <= r.c:
            return out(r.x)
        nth -= r.c
    return out(high)


def probe_summary(calls: DataFrame) -> DataFrame:
    """total, success, failed, success_rate, mean and p95 latency; calls has ok and latency_ms.

    p95 is the value at place floor(0.95 * (n - 1)) of the ordered successes, counted from 0; null without any.
    """
    p95 = nth_smallest(calls.where("ok"), "latency_ms", lambda n: math.floor(0.95 * (n - 1)) + 1).select(F.round("value", 2).alias("latency_p95"))
    base = calls.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.count_if("ok") / F.count("*"), 4).alias("success_rate"), F.round(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), 2).alias("latency_avg"))
    return base.join(p95, F.lit(True), "left")  # one row each


def histogram(rows: DataFrame, *by: str, top: int | None = None) -> DataFrame:
    """Counts by value, the most frequent first; only `top` of them where given."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)
    return out.limit(top) if top else out


def leaderboard(calls: DataFrame, by: str, latency: str = "latency_ms") -> DataFrame:
    """by, mean latency of the successes, rank from the fastest."""
    means = calls.where("ok").groupBy(by).agg(F.round(F.avg(latency), 4).alias("latency"), F.count("*").alias("calls"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("latency", by)).cast("long"))


def _letters(text: Column, line_ends: bool) -> Column:
    return F.regexp_replace(text, "[ ，。\n]" if line_ends else "[ ，。]", "")


def diversity(texts: DataFrame, group: str, column: str = "text") -> DataFrame:
    """Per group: responses, unique ones, share of the most frequent, lengths, type/token ratio of characters."""
    said = texts.where(F.length(column) > 0)
    base = said.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_distinct(column).alias("unique_texts"),
        F.min(F.length(column)).cast("long").alias("min_length"),
        F.max(F.length(column)).cast("long").alias("max_length"),
        F.round(F.avg(F.length(column)), 2).alias("avg_length"),
        F.round(F.stddev_pop(F.length(column)), 2).alias("std_length"),
    )
    mode = said.groupBy(group, column).agg(F.count("*").alias("c")).groupBy(group).agg(F.max("c").alias("most_common"))
    chars = said.select(group, F.explode(F.split(_letters(F.col(column), False), "")).alias("ch")).where("ch <> ''").groupBy(group, "ch").agg(F.count("*").alias("c")).groupBy(group).agg(F.sum("c").alias("tokens"), F.count("*").alias("types"))
    joined = base.join(mode, group).join(chars, group, "left").na.fill(0, ["tokens", "types"])
    ratio = F.when(F.col("tokens") > 0, F.round(F.col("types") / F.col("tokens"), 4)).otherwise(0.0)
    return joined.withColumns({"exact_match_ratio": F.round(F.col("most_common") / F.col("n"), 4), "type_token_ratio": ratio}).drop("tokens", "types")


def mean_overlap(texts: DataFrame, group: str, order: str, column: str = "text") -> DataFrame:
    """Per group: mean Jaccard of the character sets of all pairs of its responses; 1 for a single one.

    A group is one experiment's repeats of a prompt; its pairs are the statistic itself.
    """
    sets = texts.where(F.length(column) > 0).select(group, order, F.filter(F.array_distinct(F.split(_letters(F.col(column), True), "")), lambda c: c != "").alias("s"))
    a, b = sets.select(group, F.col(order).alias("i"), F.col("s").alias("a")), sets.select(group, F.col(order).alias("j"), F.col("s").alias("b"))
    union = F.size(F.array_union("a", "b"))
    pairs = a.join(b, group).where("i < j").where(union > 0).groupBy(group).agg(F.avg(F.size(F.array_intersect("a", "b")) / union).alias("o"))
    counts = sets.groupBy(group).agg(F.count("*").alias("n"))
    return counts.join(pairs, group, "left").select(group, F.round(F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("o", F.lit(0.0))), 4).alias("avg_char_overlap"))


def temperature_effect(groups: DataFrame) -> DataFrame:
    """corr and verdict over groups (temperature, exact_match_ratio)."""
    diversity_of = 1 - F.col("exact_match_ratio")
    r = F.try_divide(F.covar_pop("temperature", diversity_of), F.stddev_pop("temperature") * F.stddev_pop(diversity_of))  # null where nothing varies
    stats = groups.agg(
        F.count("*").alias("n"),
        F.when(F.count("*") > 2, F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))).otherwise(0.0).alias("r"),
        F.min_by("exact_match_ratio", "temperature").alias("cold"),
        F.max_by("exact_match_ratio", "temperature").alias("hot"),
    )
    verdict = F.when(F.col("n") < 2, "INSUFFICIENT").when((F.col("r") > 0.5) & (F.col("hot") < F.col("cold")), "WORKS").when(F.col("r") < -0.5, "REVERSED").when(F.abs("r") < 0.3, "IGNORED").otherwise("INCONCLUSIVE")
    return stats.select(F.round("r", 6).alias("r"), verdict.alias("verdict"))


def cache_stats(calls: DataFrame) -> DataFrame:
    """Totals over provider calls (has_usage, cache_hit, cached/prompt/completion/total tokens, mode, variant).

    A call without usage counts as missing and as nothing else; nulls count 0; the hit rate is a percentage.
    """
    used = F.col("has_usage")
    total = lambda c: F.sum(F.when(used, F.coalesce(c, F.lit(0))).otherwise(0)).cast("long").alias(f"{c}_total")
    base = calls.agg(F.count_if(used).alias("requests"), F.count_if(used & F.col("cache_hit")).alias("hits"), F.count_if(used & ~F.col("cache_hit")).alias("misses"), F.count_if(~used).alias("missing_usage"), *(total(c) for c in ("cached", "prompt", "completion", "tokens")))
    hit_rate = F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests") * 100, 1)).otherwise(0.0)
    return base.withColumn("hit_rate", hit_rate)


def count_map(calls: DataFrame, column: str) -> DataFrame:
    """One row: map of each non-empty value to its number of calls with usage."""
    counts = calls.where(F.col("has_usage") & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))


def file_structure(files: DataFrame, paper: str = "paper_id", path: str = "path") -> DataFrame:
    """Per paper: files by class, extension map, whether there are folders."""
    kind = member_class(F.col(path))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    classes = files.groupBy(paper).agg(F.count("*").alias("n_files"), *(F.count_if(kind == k).alias(f"n_{k}") for k in ("tex", "bib", "image", "style", "other")), F.bool_or(F.contains(path, F.lit("/"))).alias("has_subdirs"))
    exts = files.groupBy(paper, ext.alias("ext")).agg(F.count("*").alias("n")).groupBy(paper).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    return classes.join(exts, paper)


def paper_rollup(reports: DataFrame, needs: dict[str, int]) -> DataFrame:
    """n papers and, for every flag, how many have it, the rate, and whether it reaches what it needs."""
    cols = [F.count("*").alias("papers")]
    for flag, need in needs.items():
        n = F.count_if(F.col(flag))
        cols += [n.alias(f"{flag}_n"), F.round(n / F.count("*"), 4).alias(f"{flag}_rate"), (n >= need).alias(f"{flag}_pass")]
    return reports.agg(*cols)


def expected_terms(rows: DataFrame, key: str) -> DataFrame:
    """key, term of every expected term that the translation lacks."""
    return rows.select(key, F.explode(F.filter("expected", lambda t: ~F.contains("translation", t))).alias("term"))


def counts_in_order(calls: DataFrame, models: list[str], by: str = "model") -> DataFrame:
    """ord, by, success, errors of the given models in the given order; those without calls count 0, others are left out."""
    order = calls.sparkSession.createDataFrame(list(enumerate(models)), f"ord long, {by} string")
    counts = calls.groupBy(by).agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("errors"))
    return F.broadcast(order).join(counts, by, "left").na.fill(0, ["success", "errors"]).select("ord", by, "success", "errors").orderBy("ord")  # a hand-written list


def parse_failures(reports: DataFrame) -> DataFrame:
    """paper_id, error of the reports that could not be parsed, by id."""
    return reports.where(~F.coalesce("parsed", F.lit(False))).select("paper_id", F.coalesce("error", F.lit("unknown")).alias("error")).orderBy("paper_id")


def tally(calls: DataFrame) -> DataFrame:
    """total, success, errors, mean seconds of the successes, of calls (ok, seconds)."""
    return calls.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg(F.when(F.col("ok"), F.col("seconds"))), 4).alias("mean_seconds"))
