"""Glossary tables and term matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texmill.functions.folds import let

COLUMNS = "ord int, term string, target string, context string, domain string, priority int, notes string"


def rows_of(entries: dict) -> list[tuple]:
    """Rows from {term: target or {target, context, domain, priority, notes}}; entries of other kinds are skipped."""
    out = []
    for term, e in entries.items():
        if isinstance(e, str):
            out.append((len(out), term, e, None, None, 0, None))
        elif isinstance(e, dict) and e.get("target") is not None:
            out.append((len(out), term, e["target"], e.get("context"), e.get("domain"), int(e.get("priority") or 0), e.get("notes")))
    return out


def merged(base: DataFrame, over: DataFrame) -> DataFrame:
    """Both glossaries; a term of both takes the later entry and keeps its first place."""
    both = base.withColumn("_of", F.lit(0)).unionByName(over.withColumn("_of", F.lit(1)))
    fields = [c for c in base.columns if c not in ("term", "ord")]
    place = F.min(F.struct("_of", "ord"))
    one = both.groupBy("term").agg(place.alias("_at"), F.max_by(F.struct(*fields), F.struct("_of", "ord")).alias("_e"))
    return one.select(F.col("_at._of").alias("of"), F.col("_at.ord").alias("ord"), "term", "_e.*")


def occurs(text: Column, term: Column) -> Column:
    """The term is in the text in any case, with no ASCII word character next to it; signs in it are literal."""
    return F.rlike(text, F.concat(F.lit(r"(?i)(?<!\w)\Q"), term, F.lit(r"\E(?!\w)")))


BLOCK = 10_000


def by_blocks(rows: DataFrame, small: DataFrame, on: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows joined with a list on a condition that no key expresses: a nested loop over the broadcast list.

    The list's rows are counted first; one over `block` rows goes out in blocks of about that many, each over all of
    rows, so that no broadcast grows with it.
    """
    n = small.count()
    if n <= block:
        return rows.join(F.broadcast(small), on)
    blocks = -(-n // block) * 2
    part = F.pmod(F.xxhash64(name), F.lit(blocks))
    out = rows.join(F.broadcast(small.where(part == 0)), on)
    for k in range(1, blocks):
        out = out.unionByName(rows.join(F.broadcast(small.where(part == k)), on))
    return out


#: Glossaries of up to so many terms go into the plan as literals, whose patterns are compiled once; longer ones are joined.
LITERALS = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hits(texts: DataFrame, glossary: DataFrame, column: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row of texts with each term that occurs in it.

    A term's pattern is only tried where the term is part of the text in any case.
    """
    terms = glossary.select("term", "target")
    held = terms.limit(LITERALS + 1).collect()
    low = F.translate(F.col(column), _UPPER, _LOWER)
    if len(held) <= LITERALS:
        to_lower = str.maketrans(_UPPER, _LOWER)
        found = let(low, lambda x: F.array(*(F.when(F.contains(x, F.lit(r.term.translate(to_lower))) & occurs(F.col(column), F.lit(r.term)), F.struct(F.lit(r.term).alias("term"), F.lit(r.target).cast("string").alias("target"))) for r in held if r.term is not None)))
        empty = F.expr("cast(array() as array<struct<term:string,target:string>>)")
        each = F.filter(found, lambda x: x.isNotNull()) if any(r.term is not None for r in held) else empty
        return texts.select("*", F.explode(each).alias("_hit")).select(*texts.columns, "_hit.term", "_hit.target")
    lowered = texts.withColumn("_low", low)
    joined = by_blocks(lowered, terms.withColumn("_term", F.translate("term", _UPPER, _LOWER)), F.contains(F.col("_low"), F.col("_term")) & occurs(F.col(column), F.col("term")), "term", block)
    return joined.drop("_low", "_term")


def get(glossary: DataFrame, term: str) -> DataFrame:
    """The entry of exactly this term: one row or none."""
    return glossary.where(F.col("term") == F.lit(term))


def hints(texts: DataFrame, glossary: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, hints map, number of terms, and whether there are any, of every row."""
    found = hits(texts, glossary, column).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "target")))).alias("hints"))
    joined = texts.select(key).join(found, key, "left")
    empty = F.expr("cast(map() as map<string,string>)")
    return joined.select(key, F.coalesce("hints", empty).alias("hints"), F.coalesce(F.size("hints"), F.lit(0)).cast("long").alias("n_terms"), (F.coalesce(F.size("hints"), F.lit(0)) > 0).alias("had_terms"))


def contained(texts: DataFrame, glossary: DataFrame, column: str = "text") -> DataFrame:
    """Terms that are part of a text in any case, whatever is next to them."""
    return by_blocks(texts, glossary.select("term", "target"), F.contains(F.lower(F.col(column)), F.lower("term")), "term")


def upsert(glossary: DataFrame, term: str, target: str) -> DataFrame:
    spark = glossary.sparkSession
    new = spark.createDataFrame([(1 << 30, term, target, None, None, 0, None)], COLUMNS)
    return merged(glossary, new).drop("of")
