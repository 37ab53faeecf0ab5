"""Quality selection by importance resampling.

Two generative models of hashed n-grams are counted: one over documents labelled good (the target), one over all
documents (the raw text). A document's log weight is the sum of log(target / raw) over its n-grams: words, pairs of
words, and pairs of word shapes (case, ending, length, and whether the second repeats the first). Documents are then
sampled without replacement with chances in proportion to their weights: every log weight gets Gumbel noise, a
function of the document's id and the seed, and the k largest sums stay.

k may be given. Else it is how many documents lie above the cut that best separates the labelled sample, so that the
sample takes what looks like the target and leaves what doesn't.

The raw counts cover all documents; each task hands on one sum per hashed n-gram. Labels come as a bounded sample of
``label_rows`` rows by hash of their id (a documented parameter), which is looked up at the map side.

Defined results: null and blank texts have no n-grams, a null weight, and are never kept; equal texts have equal
weights but, under ids of their own, noise of their own; rows that agree in id and text (null ids too) are one draw, so
all or none of them stay, and what ties with the k-th key stays too (more than k rows then); a label of a null id or
quality says nothing, and of several for one id the best counts; without labels of both kinds every document with
n-grams is kept; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texmill.llm._common import keep, map_batches, read
from texmill.llm.shingles import mix

WORDS, PAIRS, SHAPES = 4096, 4096, 1024
BUCKETS = WORDS + PAIRS + SHAPES


def shape(word: bytes) -> int:
    """Case, ending and length class of a word, under 256."""
    text = word.decode(errors="replace")
    core = text.rstrip(".,;:!?%&$#*|)\"'")
    case = 0 if not any(c.isalpha() for c in core) else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() else 4
    tail = text[len(core) :]
    ending = 0 if not tail else 1 if len(tail) == 1 and tail in ".,;:" else 2 if len(tail) == 1 else 3 if len(set(tail)) == 1 else 4
    return (case * 5 + ending) * 8 + min(7, len(core).bit_length())


class Coded(dict):
    """Word -> 56 bits of hash and 8 bits of shape, bounded."""

    def __init__(self, size: int = 150_000):
        super().__init__()
        self.most = size

    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh3_64_intdigest(word) & ~0xFF | shape(word)
        if len(word) <= 64:
            self[word] = n
        return n


class Grams:
    """N-grams of a run of texts as bucket numbers, in one array, and where each text's begin."""

    def __init__(self):
        self.coded = Coded()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words, ends = [], []
        for text in texts:
            if text:
                words += text.encode().split()
            ends.append(len(words))
        if len(self.coded) > self.coded.most:
            self.coded.clear()
        w = np.fromiter(map(self.coded.__getitem__, words), np.uint64, len(words))
        ends = np.array(ends)
        one = (mix(w) % np.uint64(WORDS)).astype(np.int64)
        before = np.concatenate([[np.uint64(0)], w[:-1]]) if len(w) else w  # 0: a text begins
        firsts = np.concatenate([[0], ends[:-1]])
        before[firsts[firsts < len(w)]] = 0
        two = (mix(w * np.uint64(0x9E3779B97F4A7C15) + mix(before)) % np.uint64(PAIRS)).astype(np.int64) + WORDS
        shapes = (w & np.uint64(0xFF)) | (before & np.uint64(0xFF)) << np.uint64(8) | (w == before).astype(np.uint64) << np.uint64(16)
        three = (mix(shapes) % np.uint64(SHAPES)).astype(np.int64) + WORDS + PAIRS
        return np.stack([one, two, three], 1).reshape(-1), 3 * np.concatenate([[0], ends])


def runs(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in runs of about `most` characters, each with the place of its first."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


@dataclass
class Model:
    """Log ratio of target to raw per bucket, and the sampled labels (id -> good)."""

    ratio: Broadcast
    labels: dict


def labelled(labels: DataFrame, label_rows: int, seed: int) -> dict:
    """A bounded sample of the labels, by hash of the id."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(label_rows)
    return {r.doc_id: r.quality > 0 for r in sample.collect()}


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, seed: int = 7, prior: float = 100.0) -> Model:
    """Count both models: the raw one over all documents, the target one over the sampled good ones.

    prior is added to every raw count (and its share to the target), so that rare n-grams say little either way.
    """
    spark = docs.sparkSession
    known = labelled(labels, label_rows, seed)
    good = spark.sparkContext.broadcast({i for i, y in known.items() if y})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in runs(batch.column(1).to_pylist()):
                buckets, starts = grams.of(texts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                for k in range(len(texts)):
                    if ids[begin + k] in good.value:
                        target += np.bincount(buckets[starts[k] : starts[k + 1]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = docs.select("doc_id", "text").transform(map_batches, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = np.zeros(BUCKETS)
    if target.any():
        for a, b in ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, BUCKETS)):
            t, r, flat = target[a:b], raw[a:b], prior
            share = t.sum() / r.sum()
            ratio[a:b] = np.log((t + flat * share) / (r + flat)) - np.log(share)
    return Model(spark.sparkContext.broadcast(np.clip(ratio, -8, 8)), known)


def scored(docs: DataFrame, model: Model, size: str = "n_ngrams", weight: str = "log_weight", worth: float = 64.0, lean: float = 30.0) -> DataFrame:
    """The documents with their number of n-grams and log weight under these names."""
    ratio, names = model.ratio, docs.columns
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            n, weights = [], []
            for _, texts in runs(batch.column(at).to_pylist()):
                buckets, starts = grams.of(texts)
                ratios = ratio.value[buckets]
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    n.append(b - a)
                    weights.append(worth * float(ratios[a:b].sum()) / (b - a + lean) if b > a else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(weights, pa.float64())], [*names, size, weight])

    return docs.transform(map_batches, score, T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(weight, T.DoubleType())]))


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def gumbel_key(seed: int, weight: str = "log_weight", text: Column | None = None) -> Column:
    """A log weight plus Gumbel noise that the document's id, its text (or its digest, text_hash) and the seed fix."""
    digest = F.col("text_hash") if text is None else F.xxhash64(text)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), digest, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(weight) - F.log(-F.log(uniform))


def best_cut(keys: list[tuple[float, bool]], good_weight: float = 3.0) -> float:
    """The cut that best separates good from bad, in the middle of the best stretch.

    Shares of either kind count; losing good ones weighs good_weight times as much as keeping bad ones.
    """
    keys = sorted(keys)
    goods = sum(y for _, y in keys)
    bads = len(keys) - goods
    if not goods or not bads:
        return float("-inf")
    best, at, under_good, under_bad = good_weight, [keys[0][0] - 1], 0, 0
    for i, (x, y) in enumerate(keys[:-1]):
        under_good, under_bad = under_good + y, under_bad + (not y)
        if keys[i + 1][0] > x:
            worth = good_weight * (goods - under_good) / goods + under_bad / bads
            if worth > best + 1e-12:
                best, at = worth, []
            if worth > best - 1e-12:
                at.append((x + keys[i + 1][0]) / 2)
    return at[len(at) // 2] if at else float("-inf")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value, exactly, by histograms that narrow down; at most bins or few rows reach the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while True:
        inside = values.where((x >= low) & (x <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low or inside.count() <= few:
            break
        slot = F.least(F.floor((x - low) / width), F.lit(bins - 1))
        for r in sorted(inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: -r.slot):
            if k <= r.n:
                low, high = r.lo, r.hi
                break
            k -= r.n
    if width <= 0 or low + width == low:
        return low
    return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]


def choose(scores: DataFrame, labels: dict, k: int | None, seed: int) -> float:
    """The smallest key of the k documents with the largest keys; k from the labelled sample unless given."""
    spark = scores.sparkSession
    keyed = scores.where("log_weight is not null").withColumn("key", gumbel_key(seed))
    if k is None:
        given = spark.sparkContext.broadcast(labels)
        kinds = dict(scores.dtypes)["doc_id"]

        def only_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = [i in given.value for i in batch.column(0).to_pylist()]
                yield batch.filter(pa.array(mask, pa.bool_()))

        found = keyed.select("doc_id", "key").transform(map_batches, only_labelled, f"doc_id {kinds}, key double").groupBy("doc_id").agg(F.max("key").alias("key")).collect()  # label_rows at most
        cut = best_cut([(r.key, labels[r.doc_id]) for r in found])
        k = keyed.where(F.col("key") >= cut).count()
    if not k:
        return float("inf")
    return kth_largest(keyed, "key", k) if k < keyed.count() else float("-inf")


def _weights(docs: DataFrame, model: Model) -> DataFrame:
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return keep(scored(named, model).drop("text"), "weights")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, label_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """doc_id, n_ngrams, log_weight, gumbel_key, kept of every document."""
    model = fit(docs, labels, label_rows, seed)
    scores = _weights(docs, model)
    cut = choose(scores, model.labels, k, seed)
    keyed = scores.withColumn("gumbel_key", gumbel_key(seed))
    kept = F.coalesce(F.col("gumbel_key") >= cut, F.lit(False))
    return keyed.select("doc_id", "n_ngrams", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), kept.alias("kept"))


def only_kept(docs: DataFrame, labels: DataFrame, k: int | None = None, label_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """The documents that resample() keeps, with their columns; texts are not shuffled."""
    model = fit(docs, labels, label_rows, seed)
    cut = choose(_weights(docs, model), model.labels, k, seed)
    size, weight = fresh(docs.columns, "n_ngrams"), fresh(docs.columns, "log_weight")
    return scored(docs, model, size, weight).where(gumbel_key(seed, weight, F.col("text")) >= cut).drop(size, weight)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
