"""Routing, batching, resuming and order of translation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texmill.functions.folds import scan
from texmill.functions.text import only_placeholder, strip

SHORT, BATCH_CHARS = 300, 2000


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a stored result."""
    return chunks.join(done.select(key), key, "left_anti")


def route(content: Column, short: int = SHORT) -> Column:
    """placeholder (goes through as it is), short (is batched) or long (goes alone)."""
    return F.when(only_placeholder(content), "placeholder").when(F.length(content) < short, "short").otherwise("long")


def batch_numbers(sizes: Column, most: int = BATCH_CHARS) -> Column:
    """For sizes in order: the batch of each, filled greedily; one over the limit alone is a batch."""
    start = F.expr("named_struct('b', 0, 'used', cast(0 as bigint), 'n', 0)")

    def step(s: Column, size: Column) -> tuple[Column, Column]:
        full = (s["n"] > 0) & (s["used"] + size > most)
        b = s["b"] + full.cast("int")
        used, n = (F.when(full, F.lit(0)).otherwise(s[c]) for c in ("used", "n"))
        return F.struct(b.alias("b"), (used + size).cast("long").alias("used"), (n + 1).cast("int").alias("n")), F.array(b)

    return scan(F.transform(sizes, lambda x: x.cast("long")), start, step, "int")


def greedy_batches(units: DataFrame, group: str, order: str, column: str = "text", most: int = BATCH_CHARS) -> DataFrame:
    """group, order, batch of every unit; each group is filled in its order."""
    ordered = units.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(column).alias("n")))).alias("u"))
    return ordered.select(group, F.explode(F.arrays_zip(F.col("u.o").alias("o"), batch_numbers(F.col("u.n"), most).alias("b"))).alias("x")).select(group, F.col("x.o").alias(order), F.col("x.b").cast("long").alias("batch"))


def numbered(texts: Column) -> Column:
    """One text of `[1] first`, `[2] second` and so on, a line each."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def parse_reply(reply: Column, n: Column) -> Column:
    """The n texts of a numbered reply in order, or an empty array: wrong count, number out of range or twice."""
    pattern = r"(?s)\[(\d+)\]\s*(.*?)(?=\[\d+\]|\z)"
    at, said = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)), F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    numbers = F.transform(at, lambda x: x.try_cast("int"))
    fine = (F.size(numbers) == n) & (F.size(F.array_distinct(numbers)) == n) & F.forall(numbers, lambda x: x.between(1, n))
    ordered = F.transform(F.array_sort(F.arrays_zip(numbers.alias("i"), said.alias("t"))), lambda x: strip(x["t"]))
    return F.when(fine, ordered).otherwise(F.expr("cast(array() as array<string>)"))


#: Seconds to wait after a failed try, by kind of failure: at least, times base, to the power of the attempt.
WAITS = {"timeout": (10.0, 2.0, 2.0), "rate_limit": (5.0, 1.0, 3.0), "generic": (0.0, 1.0, 2.0)}


def backoff(kind: Column, attempt: Column, base: float = 1.0) -> Column:
    """Seconds to wait after a failed try: timeouts, rate limits and the rest have their own curve."""
    curve = lambda k: F.greatest(F.lit(WAITS[k][0]), base * WAITS[k][1] * F.pow(F.lit(WAITS[k][2]), attempt))
    return F.when(kind == "timeout", curve("timeout")).when(kind == "rate_limit", curve("rate_limit")).otherwise(curve("generic"))


def failure_kind(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("time[d ]?-?out"), "timeout").when(low.rlike("429|rate limit"), "rate_limit").otherwise("generic")
