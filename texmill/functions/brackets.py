"""Bracket and environment matching with windows, and brace tokens; no user code on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texmill.functions.folds import before, let

#: A run of text (escaped characters included) or one brace; possessive.
BRACE_TOKEN = r"((?s)(?:[^{}\\]++|\\(?:.|$))++|[{}])"
#: What matching of {} and [] steps over or stops at: escapes, other commands, brackets.
BRACKET_TOKEN = r"(?s)\\[{}\\]|\\\p{L}*+|[{}\[\]]|[^\\{}\[\]]++"


def brace_tokens(text: Column) -> Column:
    """array<struct<kind, off>>: `{`, `}` or T (a run of anything else), with 0-based offsets."""
    tokens = F.regexp_extract_all(text, F.lit(BRACE_TOKEN), F.lit(1))
    kind = lambda t: F.when(t.isin("{", "}"), t).otherwise("T")
    places = lambda ts: before(F.transform(ts, lambda t: F.length(t).cast("long")))
    return let(tokens, lambda ts: F.zip_with(ts, places(ts), lambda t, off: F.struct(kind(t).alias("kind"), off.alias("off"))))


def brackets(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, pos, bracket of every bracket that counts."""
    tokens = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(BRACKET_TOKEN), F.lit(0))).alias("ord", "token"))
    along = Window.partitionBy(key).orderBy("ord")
    placed = tokens.withColumn("pos", (F.sum(F.length("token")).over(along) - F.length("token")).cast("long"))
    return placed.where(F.col("token").isin("{", "}", "[", "]")).select(key, "pos", F.col("token").alias("bracket"))


def matched(tokens: DataFrame, opens: Column, keys: list[str], order: str = "pos") -> DataFrame:
    """tokens with `depth`, `stray` (a closer without an opener) and `close` (where an opener's closer is).

    Depth is a reflected walk: it goes up at openers and down at closers but never under zero, so stray closers
    change nothing. An opener and the next token of its depth's key are a pair.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    walk = tokens.withColumn("_opens", opens).withColumn("_s", F.sum(F.when(F.col("_opens"), 1).otherwise(-1)).over(along))
    walk = walk.withColumn("_m", F.least(F.lit(0), F.min("_s").over(along)))
    walk = walk.withColumn("_before", F.coalesce(F.lag("_m").over(along), F.lit(0)))
    walk = walk.withColumns({"depth": (F.col("_s") - F.col("_m")).cast("long"), "stray": ~F.col("_opens") & (F.col("_m") < F.col("_before"))})
    walk = walk.withColumn("_k", F.when(F.col("stray"), F.lit(-1)).otherwise(F.when(F.col("_opens"), F.col("depth")).otherwise(F.col("depth") + 1)))
    same = Window.partitionBy(*keys, "_k").orderBy(order)
    closing = F.when(F.col("_opens"), F.lead(order).over(same))
    return walk.withColumn("close", closing).withColumn("open_at", F.when(~F.col("_opens") & ~F.col("stray"), F.lag(order).over(same))).drop("_opens", "_s", "_m", "_before", "_k")


def unbalanced(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, pos, bracket, problem (unmatched closer, unmatched opener, mismatched) of every bracket in error."""
    found = matched(brackets(docs, key, column), F.col("bracket").isin("{", "["), [key])
    opener = found.select(F.col(key).alias("k2"), F.col("pos").alias("p2"), F.col("bracket").alias("opener"))
    both = found.join(opener, (found[key] == opener.k2) & (found.open_at == opener.p2), "left")
    pair = F.concat("opener", "bracket")
    problem = F.when(F.col("stray"), "unmatched closer").when(F.col("bracket").isin("{", "[") & F.col("close").isNull(), "unmatched opener").when(F.col("opener").isNotNull() & ~pair.isin("{}", "[]"), "mismatched")
    return both.withColumn("problem", problem).where("problem is not null").select(key, "pos", "bracket", "problem")


def environments(docs: DataFrame, names: list[str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, env, first, stop of the outermost occurrences of each named environment (nested same names counted)."""
    pattern = r"\\(?:begin|end)\{(?:" + "|".join(n.replace("*", r"\*") for n in names) + r")\}"
    tokens = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(column), pattern, -1)
    rows = docs.select(key, F.posexplode(F.arrays_zip(tokens.alias("token"), F.slice(gaps, F.lit(1), F.size(tokens)).alias("gap"))).alias("ord", "x"))
    along = Window.partitionBy(key).orderBy("ord")
    rows = rows.select(key, "ord", F.col("x.token").alias("token"), F.length("x.gap").alias("gap"))
    stop = F.sum(F.col("gap") + F.length("token")).over(along)
    placed = rows.withColumns({"first": (stop - F.length("token")).cast("long"), "stop": stop.cast("long"), "env": F.regexp_extract("token", r"\{(.*)\}", 1)})
    pairs = matched(placed, F.col("token").startswith("\\begin"), [key, "env"], "first")
    ends = placed.select(F.col(key).alias("k2"), F.col("first").alias("f2"), F.col("stop").alias("end_stop"))
    whole = pairs.where("depth = 1 and close is not null and token like '_begin%'").join(ends, (pairs[key] == ends.k2) & (F.col("close") == F.col("f2")))
    return whole.select(key, "env", "first", F.col("end_stop").alias("stop"))
