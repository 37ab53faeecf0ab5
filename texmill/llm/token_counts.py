"""Token counts by a map-side two-tier lookup.

A sentencepiece BPE model without pieces that span a word end counts each pre-token (a run of spaces and the
characters up to the next space) on its own. Tier one is a compact table of the corpus's frequent pre-tokens and
their lengths, built from bounded summaries of all partitions and broadcast. Tier two is a bounded cache in each
worker; a miss is encoded and remembered. No pre-token of the documents is ever shuffled: only at most
``per_partition`` summary rows leave a partition.

Defined results: null and empty text count 0 tokens and 0 bytes; repeated rows are counted each for itself; extra
columns are ignored; an empty table gives an empty result. Texts that hold the model's own space mark U+2581 are
encoded whole, since there the split would not be exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import map_batches, read

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text without U+2581, each without one leading space (the model adds it again)."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


def frequent_pretokens(docs: DataFrame, table_size: int = 8192, per_partition: int = 2048, counter_size: int = 200_000) -> list[str]:
    """The corpus's most frequent pre-tokens, by counts over all documents.

    Each partition counts with a bounded counter (halved when full, losing only the rarest) and hands on its
    per_partition largest. At most table_size strings of at most 64 characters reach the driver.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pretokens(text))
                    if len(seen) > counter_size:
                        seen = Counter(dict(seen.most_common(counter_size // 2)))
        best = [(t, n) for t, n in seen.most_common(per_partition) if len(t) <= 64 and MARK not in t]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["pretoken", "n"])

    rows = docs.select("text").transform(map_batches, top, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(table_size).collect()
    return [r.pretoken for r in rows]


class Lengths(dict):
    """Pre-token -> number of tokens. Starts with the frequent ones; learns what it is asked for."""

    def __init__(self, model, frequent: dict[str, int], size: int):
        super().__init__(frequent)
        self.model, self.frequent, self.most = model, frequent, size
        self[""] = len(model.encode("x ")) - len(model.encode("x"))

    def __missing__(self, key: str) -> int:
        n = len(self.model.encode(key))
        if len(key) <= 256:
            self[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            return len(self.model.encode(text))
        if len(self) > self.most:
            self.clear()
            self.__init__(self.model, self.frequent, self.most)
        return sum(map(self.__getitem__, pretokens(text)))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = 8192, cache_size: int = 150_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row of docs."""
    import sentencepiece

    spark = docs.sparkSession
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("this model has pieces that span a word end; counts by pre-token would not be exact")
    names = frequent_pretokens(docs, table_size)
    table = spark.sparkContext.broadcast({t: len(ids) for t, ids in zip(names, model.encode(names), strict=True)} if names else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        lengths = Lengths(sentencepiece.SentencePieceProcessor(model_file=model_path), table.value, cache_size)
        for batch in batches:
            n = pa.array([lengths.count(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.transform(map_batches, count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
