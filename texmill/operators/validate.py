"""Checks of a translation against its original, as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texmill.functions.brackets import brace_tokens, unbalanced
from texmill.functions.folds import before, let
from texmill.functions.text import PLACEHOLDER, line_and_column, snippet, strip
from texmill.operators.glossary import by_blocks

LEAST_RATIO, MOST_RATIO = 0.2, 1.5


def arguments(text: Column, command: str) -> Column:
    """Distinct raw arguments of a command, sorted; lists inside stay whole."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\\{command}\{{([^}}]+)\}}"), F.lit(1))))


def dollar_count(text: Column) -> Column:
    """Math delimiters, without placeholders and escaped dollars."""
    x = F.replace(F.regexp_replace(text, PLACEHOLDER, ""), F.lit("\\$"), F.lit(""))
    return (F.length(x) - F.length(F.replace(x, F.lit("$"), F.lit("")))).cast("long")


def first_brace_mismatch(source: Column, translated: Column) -> Column:
    """struct(index, expected, got, source_off, translated_off) of the first difference in brace structure, or null.

    Both are read as tokens `{`, `}` and T (a run of anything else); past the end stands <EOF>.
    """
    a, b = brace_tokens(source), brace_tokens(translated)
    end = lambda text: F.struct(F.lit("<EOF>").alias("kind"), F.length(text).cast("long").alias("off"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, end(source)).alias("x"), F.coalesce(y, end(translated)).alias("y")))
    differs = F.transform(pairs, lambda p, i: F.struct(i.cast("long").alias("index"), p["x"]["kind"].alias("expected"), p["y"]["kind"].alias("got"), p["x"]["off"].alias("source_off"), p["y"]["off"].alias("translated_off")))
    return F.get(F.filter(differs, lambda d: d["expected"] != d["got"]), F.lit(0))


def _finding(check: str, when: Column, message: Column, severity: str = "error") -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")))


def pair_findings(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, check, severity, message of the checks that compare texts (citations, references, math, length).

    pairs has original and translated; a null original skips the comparison.
    """
    o, t = F.col("original"), F.col("translated")
    lost = lambda c: F.array_except(arguments(o, c), arguments(t, c))
    more = F.array_except(arguments(t, "cite"), arguments(o, "cite"))
    do, dt = dollar_count(o), dollar_count(t)
    ratio = F.length(t) / F.length(o)
    said = strip(o) != ""
    checks = F.array(
        _finding("citations", F.size(lost("cite")) > 0, F.concat(F.lit("Missing citations: "), F.array_join(lost("cite"), ", "))),
        _finding("citations", F.size(more) > 0, F.concat(F.lit("Unexpected citations: "), F.array_join(more, ", "))),
        _finding("references", F.size(lost("ref")) > 0, F.concat(F.lit("Missing references: "), F.array_join(lost("ref"), ", "))),
        _finding("math", dt % 2 == 1, F.lit("Odd number of math delimiters")),
        _finding("math", do != dt, F.concat_ws(" ", F.lit("Math delimiters differ:"), do.cast("string"), F.lit("and"), dt.cast("string"))),
        _finding("length", said & (ratio < LEAST_RATIO), F.lit("Translation is very short"), "warning"),
        _finding("length", said & (ratio > MOST_RATIO), F.lit("Translation is very long"), "warning"),
    )
    return pairs.where(o.isNotNull() & t.isNotNull()).select(key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def brace_findings(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    found = unbalanced(docs, key, column)
    return found.select(key, F.lit("braces").alias("check"), F.lit("error").alias("severity"), F.concat_ws(" ", "problem", "bracket").alias("message"), F.col("pos").alias("location"))


def chunk_brace_findings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks (source, translation, start_line) whose brace structure changed, with line, column and a snippet."""
    m = F.col("m")
    found = chunks.withColumn("m", first_brace_mismatch(F.col("source"), F.col("translation"))).where("m is not null")
    place = line_and_column(F.col("translation"), m["translated_off"].cast("int"))
    return found.select(
        key,
        m["index"].alias("index"),
        m["expected"].alias("expected"),
        m["got"].alias("got"),
        (place["line"] + F.coalesce("start_line", F.lit(1)) - 1).alias("line"),
        place["col"].alias("col"),
        snippet(F.col("translation"), m["translated_off"].cast("int")).alias("snippet"),
    )


#: Lists of up to so many patterns go into the plan as literals, which are compiled once; longer ones are joined.
LITERALS = 200


def _places(text: Column, pattern: Column) -> Column:
    """0-based places of all matches."""
    pair = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        gaps = F.transform(F.slice(x["gaps"], F.lit(1), F.size(x["values"])), lambda g: F.length(g))
        sizes = F.zip_with(gaps, x["values"], lambda g, v: (g + F.length(v)).cast("long"))
        return F.zip_with(before(sizes), gaps, lambda at, g: (at + g).cast("int"))

    return let(pair, placed)


def rule_findings(docs: DataFrame, rules: DataFrame, key: str = "doc_id", column: str = "text", trigger: str | None = None) -> DataFrame:
    """One finding per match of each rule, with its place; rules of another trigger are left out.

    A list of up to LITERALS rules is part of the plan; the join with a longer one is a nested loop, in blocks.
    """
    chosen = rules if trigger is None else rules.where(F.col("trigger").isNull() | (F.col("trigger") == trigger))
    fields = ("id", "severity", "description", "replacement")
    held = chosen.select(*fields, "pattern").limit(LITERALS + 1).collect()
    if len(held) > LITERALS:
        joined = by_blocks(docs, chosen, F.rlike(F.col(column), F.col("pattern")), "id").withColumn("places", _places(F.col(column), F.col("pattern")))
        found = joined.select(key, *fields, "places")
    else:
        none = F.expr("cast(array() as array<int>)")
        texts = F.col(column)
        every = [F.struct(*(F.lit(r[c]).cast("string").alias(c) for c in fields), F.when(texts.rlike(r.pattern), _places(texts, F.lit(r.pattern))).otherwise(none).alias("places")) for r in held]
        if not every:
            every = [F.struct(*(F.lit(None).cast("string").alias(c) for c in fields), none.alias("places"))]
        found = docs.select(key, F.explode(F.array(*every)).alias("f")).select(key, "f.*")
    return found.select(key, "id", "severity", "description", F.col("replacement").alias("suggestion"), F.explode("places").alias("location"))


def verdict(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, valid (no finding of severity error), n_errors, n_warnings, of every document."""
    per = findings.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = docs.select(key).join(per, key, "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.select(key, (F.col("n_errors") == 0).alias("valid"), "n_errors", "n_warnings")


def _compiles(pattern: str, replacement: str) -> bool:
    """Whether the engine that will run it takes the pattern and the replacement."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        spark.range(1).select(F.regexp_replace(F.concat(F.lit("a"), F.col("id").cast("string")), pattern, replacement)).collect()
    except PySparkException:
        return False
    return True


def auto_fix(text: Column, rules: list[dict]) -> Column:
    """The rules' replacements in order; \\1 in a replacement is a group.

    A rule without a replacement, or with a pattern that the engine doesn't take, changes nothing.
    """
    import re

    for r in rules:
        if r.get("replacement") is not None:
            put = re.sub(r"\\(\d)", r"$\1", r["replacement"].replace("$", "\\$"))
            if _compiles(r["pattern"], put):
                text = F.regexp_replace(text, r["pattern"], put)
    return text


def aligned_braces(source: Column, translated: Column) -> Column:
    """The translation with its i-th run of braces replaced by the source's i-th; runs it has beyond those go."""
    run = r"(?<!\\)[{}](?:[{}])*"
    wanted, texts = F.regexp_extract_all(source, F.lit(run), F.lit(0)), F.split(translated, run, -1)
    n = F.size(texts)
    return F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.when(i < n - 1, F.coalesce(F.get(wanted, i), F.lit(""))).otherwise(""))), "")
