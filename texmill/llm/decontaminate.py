"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 13 consecutive words (a shorter item is one window). Windows are sets of 3-word
shingles with their places. Shingles are ordered by rarity over all documents; containment of a whole window needs
all its shingles, so its necessary prefix is one shingle, the rarest. A document joins a window on that shingle
alone; the shingle's place must leave room for the window before and after it (positional bound), the document must
be long enough (length bound), and then all words are compared (exact containment). Windows that join a document at
the same place as the window before them extend the same hit.

The benchmark goes to the workers in blocks of some ``block_bytes`` of text, so what is broadcast has a fixed bound
however large the benchmark is. Long items are split into stretches of ``STRETCH`` windows, which go to any blocks. With
several blocks the rows are stored once with a number each, by which their results are merged. Documents are never
shuffled otherwise.

Defined results: null or empty text has no words and no hit; items without words have no window; repeated items
count as each their own item, those of a null id hit but are not listed; an empty benchmark leaves every document
clean; every row has its own result, rows of null or repeated ids too, and is kept or dropped by its own text; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import keep, map_batches, read
from texmill.llm.shingles import mix

#: Bytes to words: A-Z lower-cased, all other ASCII but 0-9 and a-z a blank; bytes over 0x7F belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


STRETCH = 4096
_MULTIPLIERS = np.random.default_rng(1_729).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Windows:
    """The windows of some items, with what a document is matched against."""

    def __init__(self, items: list[tuple[object, str | None]], size: int, gram: int = 3):
        self.size, self.gram = size, gram
        self.vocabulary: dict[bytes, int] = {}
        self.words: dict[tuple[int, ...], set[object]] = {}
        self.shingles: dict[tuple[int, ...], np.ndarray] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            n = min(size, len(ids))
            g = min(gram, n)
            at = self.shingles_at(np.array(ids, np.int64), g) if ids else None
            for i in range(len(ids) - n + 1 if ids else 0):
                window = ids[i : i + n]
                of = self.words.get(window)
                if of is None:
                    of = self.words[window] = set()
                    self.shingles[window] = at[i : i + n - g + 1]
                if item is not None:
                    of.add(item)
        self.rarest: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers (0: in no item), each text followed by a 0; where each text begins."""
        words, starts = [], [0]
        for text in texts:
            words += words_of(text)
            words.append(b"")
            starts.append(len(words))
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)), np.array(starts)

    def shingles_at(self, ids: np.ndarray, g: int) -> np.ndarray:
        """Number of the g words at every place; 0 where one of them is in no item."""
        n = len(ids) - g + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.full(n, g, np.uint64), np.ones(n, bool)
        for k in range(g):
            out += mix(ids[k : k + n].astype(np.uint64) * _MULTIPLIERS[k])
            known &= ids[k : k + n] > 0
        out = (mix(out) | np.uint64(1)).view(np.int64)  # words are compared in the end, so two shingles may share a number
        out[~known] = 0
        return out

    def grams(self) -> list[int]:
        return sorted({min(self.gram, len(w)) for w in self.words})

    def order(self, frequency: dict[int, int]) -> None:
        """Choose each window's rarest shingle, by corpus counts, ties to the earlier place."""
        for window, numbers in self.shingles.items():
            at, number = min(enumerate(numbers.tolist()), key=lambda x: (frequency.get(x[1], 0), x[0]))
            self.rarest.setdefault(number, []).append((at, window))
        self.shingles = {}

    def places(self, ids: np.ndarray, keys: Keys) -> Iterator[tuple[int, int]]:
        """(place, shingle) of every occurrence of a key."""
        for g in self.grams():
            at = self.shingles_at(ids, g)
            hit = keys.among(at)
            yield from zip(hit.tolist(), at[hit].tolist(), strict=True)

    def occurrences(self, ids: np.ndarray, keys: Keys) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(place, window) of every window that occurs; a 0 between two texts is in no window."""
        n = len(ids)
        for place, number in self.places(ids, keys):
            for at, window in self.rarest[number]:
                begin = place - at
                if begin >= 0 and begin + len(window) <= n and ids[begin] == window[0] and tuple(ids[begin : begin + len(window)].tolist()) == window:
                    yield begin, window

    def match(self, texts: list[str | None], keys: Keys) -> Iterator[tuple[int, list[tuple[int, int]], set[object]]]:
        """Per text: words, word spans [from, to) that windows cover, merged, and the items whose windows occur."""
        ids, starts = self.numbers(texts)
        spans, items = defaultdict(list), defaultdict(set)
        for begin, window in self.occurrences(ids, keys):
            k = int(np.searchsorted(starts, begin, "right")) - 1
            begin -= int(starts[k])
            spans[k].append((begin, begin + len(window)))
            items[k].update(self.words[window])
        for k, n in enumerate((np.diff(starts) - 1).tolist()):
            yield n, merged(spans[k]) if k in spans else [], items[k] if k in items else set()


class Keys:
    """Shingle numbers to look for, behind a small table that rules out nearly all others."""

    def __init__(self, numbers):
        self.sorted = np.array(sorted(numbers), np.int64)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.slots(self.sorted)] = True

    @staticmethod
    def slots(numbers: np.ndarray) -> np.ndarray:
        return (numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def among(self, numbers: np.ndarray) -> np.ndarray:
        """Places of those that are keys."""
        if not len(self.sorted) or not len(numbers):
            return np.empty(0, np.int64)
        may = np.flatnonzero(numbers)
        may = may[self.table[self.slots(numbers[may])]]
        found = numbers[may]
        return may[self.sorted[np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)] == found]


def groups_of(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The batch's texts in runs of about `most` characters."""
    run, size = [], 0
    for text in batch.column(column).to_pylist():
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _count_shingles(docs: DataFrame, windows) -> dict[int, int]:
    """How often each shingle of a block's windows occurs in all documents; no more rows than the block has shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        keys = Keys(np.unique(np.concatenate([*w.shingles.values(), np.empty(0, np.int64)])).tolist())
        seen: Counter[int] = Counter()
        for batch in batches:
            for texts in groups_of(batch, 0):
                ids, _ = w.numbers(texts)
                for g in w.grams():
                    at = w.shingles_at(ids, g)
                    seen.update(dict(zip(*(x.tolist() for x in np.unique(at[keys.among(at)], return_counts=True)), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    return {r.shingle: r.n for r in docs.select("text").transform(map_batches, count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()}


def stretches(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id (as a string), text of at most STRETCH windows: together they have the windows of the items."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)), F.lit(STRETCH))
    return items.select("item_id", "words", F.explode(firsts).alias("first")).select("item_id", F.array_join(F.slice("words", F.col("first"), F.lit(STRETCH + size - 1)), " ").alias("text"))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, spans (word places covered by windows), items (ids as strings, sorted) of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = stretches(benchmark, size)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    items = items if blocks == 1 else keep(items, "stretches")
    docs = docs.withColumn("row", F.lit(0).cast("long")) if blocks == 1 else keep(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    schema = f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
    parts = []
    for k in range(blocks):
        windows = Windows([(r.item_id, r.text) for r in items.where(F.col("block") == k).toLocalIterator()], size)
        windows.order(_count_shingles(docs, spark.sparkContext.broadcast(windows)))
        given = spark.sparkContext.broadcast(windows)

        def match(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            w = given.value
            keys = Keys(w.rarest)
            for batch in batches:
                n, spans, found = [], [], []
                for texts in groups_of(batch, 1):
                    for size, hit, of in w.match(texts, keys):
                        n.append(size)
                        spans.append([{"first": a, "last": b} for a, b in hit])
                        found.append(sorted(of))
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])

        parts.append(docs.transform(map_batches, match, schema))
    if blocks == 1:
        return parts[0].drop("row")
    out = keep(parts[0], "hits")
    for part in parts[1:]:
        out = out.union(keep(part, "hits"))
    whole = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr(
        "aggregate(s, cast(array() as array<struct<first:long,last:long>>), (acc, x) -> CASE WHEN size(acc) > 0 AND x.first <= element_at(acc, -1).last"
        " THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))) ELSE concat(acc, array(x)) END)"
    )
    return whole.select("doc_id", "n_words", joined.alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    """Per document its words, hit words, items, and whether at least one in `one_in` words is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    out = find_hits(docs, benchmark, size).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20) -> DataFrame:
    """The documents that are not contaminated."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")  # ids can be null or repeated, and the text alone decides
    gone = keep(contamination(texts, benchmark, size, one_in).where("contaminated").select(F.col("doc_id").alias("_digest")).distinct(), "contaminated")
    return docs.join(gone, F.md5(docs["text"]) == gone["_digest"], "left_anti").select(docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
