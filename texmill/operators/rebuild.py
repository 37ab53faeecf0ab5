"""Documents from templates, translated chunks and placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texmill.functions.text import CHUNK_TOKEN, PLACEHOLDER, escape_specials

ROUNDS = 10
_TOKEN = re.compile(f"{PLACEHOLDER}|{CHUNK_TOKEN}")
#: Where a chunk begins while a document is put together; private-use characters.
_MARK = re.compile("\ue000(\\d+)\ue001")


def chunk_text(content, translated, wrapper, context):
    """What goes in for a chunk: the escaped translation, or the content as it is, in the wrapper."""
    said = F.when(translated.isNull() | (context == "protected"), F.coalesce(translated, content)).otherwise(escape_specials(translated))
    return F.replace(wrapper, F.lit("%s"), said)


def expand(text: str, known: dict[str, str], rounds: int = ROUNDS) -> str:
    """Tokens replaced by what they stand for until none is left that is known; nesting deeper than `rounds` stays."""
    for _ in range(rounds):
        new = _TOKEN.sub(lambda m: known.get(m[0], m[0]), text)
        if new == text:
            break
        text = new
    return text


def rebuild(parsed: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """doc_id, tex, start_lines (chunk id -> 1-based line of its first line) of every parsed document.

    translations has chunk_id and translation; without them the result is the parsed text again. A document is one
    group: it is the size of one file.
    """
    if translations is None:
        done = parsed.withColumn("translation", F.lit(None).cast("string"))
    else:
        done = parsed.join(translations.select(F.col("chunk_id").alias("id"), "translation"), "id", "left")
    filled = F.when(F.col("kind") == "chunk", chunk_text(F.col("content"), F.col("translation"), F.col("wrapper"), F.col("context"))).otherwise(F.col("content"))
    ready = done.select("doc_id", "kind", "ord", "id", "wrapper", filled.alias("content"))

    grouped = ready.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "ord", "id", "wrapper", "content")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [whole(parts) for parts in batch.column(1).to_pylist()]
            lines = pa.array([list(m[1].items()) for m in made], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), lines], ["doc_id", "tex", "start_lines"])

    return grouped.mapInArrow(run, "doc_id string, tex string, start_lines map<string,int>")


def whole(parts: list[dict]) -> tuple[str, dict[str, int]]:
    """A document's text from its template, chunks and placeholders, and the line on which each chunk begins."""
    chunks, known = [], {}
    parts = sorted(parts, key=lambda p: p["ord"])
    for p in parts:
        if p["kind"] == "chunk":
            lead = p["wrapper"].partition("%s")[0]
            known[f"{{{{CHUNK_{p['id']}}}}}"] = f"{lead}\ue000{len(chunks)}\ue001{p['content'][len(lead) :]}"
            chunks.append(p["id"])
        elif p["kind"] == "placeholder":
            known[p["id"]] = p["content"]
    marked = expand("".join(p["content"] for p in parts if p["kind"] == "template"), known)
    out, line, lines, at = [], 1, {}, 0
    for m in _MARK.finditer(marked):
        piece = marked[at : m.start()]
        line += piece.count("\n")
        lines.setdefault(chunks[int(m[1])], line)
        out.append(piece)
        at = m.end()
    return "".join([*out, marked[at:]]), lines


def leftovers(rebuilt: DataFrame) -> DataFrame:
    """doc_id, token of tokens that nothing stands for."""
    return rebuilt.select("doc_id", F.explode(F.regexp_extract_all("tex", F.lit(_TOKEN.pattern), F.lit(0))).alias("token"))


def written(rebuilt: DataFrame, folder: str) -> str:
    """Write one .tex text per document under folder/doc_id=...; gives the folder."""
    rebuilt.select("doc_id", F.col("tex").alias("value")).write.partitionBy("doc_id").mode("overwrite").text(folder)
    return folder
