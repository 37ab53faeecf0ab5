"""System prompts and message lists as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_STYLE = "Translate the scientific text you are given into the target language."
FIXED_RULES = "Keep every token in double square brackets and every LaTeX command as it is. Answer with the translation alone."
CONSISTENCY = "Stay with the wording of your earlier answers in this document."
BATCH_RULES = "You get numbered passages. Answer each with its number in square brackets, in the same order."


def system_prompt(style: Column | None = None, hints: Column | None = None, context: Column | None = None, stateful: bool = False) -> Column:
    """Style, fixed rules, consistency for stateful providers, glossary and context; empty sections are left out."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(hints)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n") if hints is not None else None
    parts = [
        F.coalesce(F.nullif(style, F.lit("")), F.lit(DEFAULT_STYLE)) if style is not None else F.lit(DEFAULT_STYLE),
        F.lit(FIXED_RULES),
        F.lit(CONSISTENCY) if stateful else None,
        F.when(F.size(hints) > 0, F.concat(F.lit("Glossary:\n"), entries)) if hints is not None else None,
        F.when(F.length(context) > 0, F.concat(F.lit("Context:\n"), context)) if context is not None else None,
    ]
    return F.concat_ws("\n\n", *(p for p in parts if p is not None))


def merged_context(context: Column, abstract: Column, batch: bool = False) -> Column:
    """Context and abstract under a label, with the batch rules before them; null if there is nothing to say."""
    said = F.concat_ws("\n", F.lit(BATCH_RULES) if batch else F.lit(None).cast("string"), F.nullif(context, F.lit("")), F.when(F.length(abstract) > 0, F.concat(F.lit("Abstract: "), abstract)))
    return F.nullif(said, F.lit(""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column, examples: Column, user: Column, history: Column | None = None) -> Column:
    """System, a user and an assistant message per example (those with a blank side are left out), history, user."""
    fine = F.filter(examples, lambda e: (F.trim(e["source"]) != "") & (F.trim(e["target"]) != ""))
    shots = F.flatten(F.transform(fine, lambda e: F.array(message("user", e["source"]), message("assistant", e["target"]))))
    return F.concat(F.array(message("system", system)), shots, *([history] if history is not None else []), F.array(message("user", user)))


def history(units, group: str, order: str):
    """Each unit's earlier exchanges of its group, in order; failed ones (null translation) leave no trace."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pair = F.when(F.col("translation").isNotNull(), F.array(message("user", F.col("source")), message("assistant", F.col("translation"))))
    return units.withColumn("history", F.flatten(F.collect_list(pair).over(before)))
