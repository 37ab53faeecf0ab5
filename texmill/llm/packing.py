"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

Documents become token ids plus one end id; longer ones are cut into full pieces (the first takes the remainder).
Best-fit decreasing looks at lengths alone, so it runs on the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus holds): a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and a whole group of equal bins takes its pieces in one move. The result equals placing piece
after piece. The moves are a table of bounded size; each piece finds its own by (length, rank within the length).
Ranks come from per-partition counts and prefix sums over them, so no length is gathered in one task.

Defined results: null text is an empty document (one end id); documents of no rows give no pieces; repeated rows are
packed each for itself; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texmill.llm._common import keep, map_batches, read

# How byte-level BPE cuts a text into pre-tokens, and the characters on whose classes all Unicode versions agree.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNSETTLED = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))).replace("\x00-", "\\x00-") + "]")


def _byte_of_letter() -> dict[str, int]:
    """A byte-level vocabulary writes a visible Latin-1 byte as itself and the n-th other byte as code point 256 + n."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit, equal to the tokenizer file's.

    Texts of settled characters and without special strings go through an encoder of the same vocabulary that is
    several times as fast; all others through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        spec = json.loads(self.tokenizer.to_str())
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        plain = model["type"] == "BPE" and not (spec.get("normalizer") or spec.get("post_processor") or spec.get("truncation") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if plain and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            import tiktoken

            byte = _byte_of_letter()
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
            del spec, model
            self.fast = tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and (text.isascii() or not _UNSETTLED.search(text)) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = array("I", ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()


class Tightest:
    """Segment tree over remaining capacities: which have open bins, and the smallest of them that is large enough."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.n)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        self.groups[room].append((first, n))
        i = room + self.n
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        if not self.groups[room]:
            i = room + self.n
            self.any[i] = 0
            while (i := i >> 1) and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
        return group

    def find(self, need: int) -> int | None:
        i = need + self.n
        while not self.any[i]:
            while i & 1:  # a right child: go up
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.n:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.n


def best_fit_moves(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Moves by length as (first rank, pieces per bin, first bin, offset in the bin), and the number of bins."""
    open_bins, bins = Tightest(capacity), 0
    moves: dict[int, list[tuple[int, int, int, int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, rank, out = histogram[length], 0, moves.setdefault(length, [])
        while left:
            room = open_bins.find(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins.take(room)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((rank, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                if room - each * length:
                    open_bins.add(room - each * length, first, full)
            if full < n and 0 < left < each:
                out.append((rank, left, first + full, capacity - room))
                open_bins.add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                open_bins.add(room, first + full, n - full)
    return moves, bins


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with its partition and its rank among the partition's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, ranks = Ids(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end, names = end_id.to_bytes(4, "little"), ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = ids.encode(text) + end
                total = len(raw) // 4
                begin, size, piece = 0, (total - 1) % capacity + 1, 0
                while begin < total:
                    at.append(k)
                    rows.append((piece, begin, size, zlib.crc32(memoryview(raw)[4 * begin : 4 * (begin + size)]), part, ranks[size]))
                    ranks[size] += 1
                    begin, size, piece = begin + size, capacity, piece + 1
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cols], names)

    return docs.select("doc_id", "text").transform(map_batches, cut, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = keep(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    moves = spark.sparkContext.broadcast(best_fit_moves(histogram, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {length: ([m[0] for m in found], found) for length, found in moves.value.items()}
        for batch in batches:
            bins, offsets = [], []
            for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                starts, found = table[length]
                begin, each, first, offset = found[bisect_right(starts, rank) - 1]
                bins.append(first + (rank - begin) // each)
                offsets.append(offset + (rank - begin) % each * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.transform(map_batches, place, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
