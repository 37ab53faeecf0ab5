"""Repeated passages by content-defined chunking with a gear rolling hash.

A text is a run of words (white space between them doesn't count). A gear hash rolls over the words; a chunk begins
where the hash is the smallest among ``REACH`` words to either side. Chunk ends so depend on the nearest words alone:
an insertion moves the ends around it and no others, and a passage is cut alike wherever it stands. A key is the
digest of the chunks from one beginning on, as many as have ``least`` words together.

1. Keys are counted over all documents; those in two documents are repeated. Partial sums meet in one shuffle, then
   the chunks look their keys up. Keys with more than one in HOT of all chunks, at most HOT, are looked up at the map
   side, so none can fill a partition.
2. Neighbouring repeated chunks of a document make runs. Groups of them of at least ``min_words`` words get digests
   of their own, and a group that another document holds is a repeated passage.
3. A passage hardly longer than min_words may hold no such group. For what is left of the runs, where chunk ends allow
   a passage, the rarest key of every stretch of min_words words is taken; all documents that hold one of those keys
   give the digests of all windows of exactly min_words words around it, and windows that two documents hold are
   repeated passages. This search is exact.

So a document has a span exactly if min_words words of it in a row stand in another document. The ends of a span from
step 2 may lie up to a chunk and ``least`` words inside the common passage; those from step 3 are exact.

Defined results: null, empty and short texts have no spans; a passage repeated within one document alone is no
repeat; rows that agree in id and text are one document, and their spans are given once; rows of null id, or of one
id, with different texts are different documents (text_hash tells them apart); offsets and sizes are UTF-8 bytes of
the text as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texmill.llm._common import Workspace, map_batches, read
from texmill.llm.resampling import fresh, runs
from texmill.llm.shingles import mix

REACH, HOT = 3, 10_000
_BYTE = np.random.default_rng(640_320).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: Stands for a null doc_id, so that it can be grouped and joined.
_NO_ID = -(1 << 63)
_OWN = ["id", "t"]


class Powers:
    """Powers of an odd number and of its inverse, as far as needed so far."""

    def __init__(self):
        self.size = 0

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = n
            self.up = np.cumprod(np.full(n, _POWER), dtype=np.uint64)
            self.down = np.cumprod(np.full(n, _INVERSE), dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Sums:
    """Digests of any stretches of a row of 64-bit numbers."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.of(len(values) + 1)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1], dtype=np.uint64)])

    def digest(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[first]) * self.down[first] + (stop - first).astype(np.uint64))


class Worded:
    """The words of some texts: where each begins and ends, which text it is in, and a number of it."""

    def __init__(self, texts: list[str | None], powers: Powers):
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, np.int64)
        self.begins = np.concatenate([[0], stops[:-1]]).astype(np.int64) if raw else np.empty(0, np.int64)
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.first, self.stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.text = np.searchsorted(self.begins, self.first, "right") - 1
        self.number = Sums(_BYTE[data], powers).digest(self.first, self.stop)
        #: First word of each text, and of what would follow the last.
        self.starts = np.searchsorted(self.text, np.arange(len(raw) + 1))
        self.sums = Sums(self.number, powers)

    def cuts(self) -> np.ndarray:
        """Words that begin a chunk."""
        h = self.number.copy()
        h[1:] += np.where(self.text[1:] == self.text[:-1], self.number[:-1] << np.uint64(1), np.uint64(0))
        cut = np.ones(len(h), bool)
        for k in range(1, REACH + 1):
            apart = self.text[k:] != self.text[:-k]
            cut[k:] &= (h[k:] <= h[:-k]) | apart
            cut[:-k] &= (h[:-k] <= h[k:]) | apart
        cut[self.starts[:-1][np.diff(self.starts) > 0]] = True
        return np.flatnonzero(cut)


class Chunker:
    """Chunks of a run of texts."""

    def __init__(self, least: int = 8):
        self.least, self.powers = least, Powers()

    def chunks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every chunk: which text, its key, where the key's words begin, and how far they and a passage reach.

        place: byte << 32 | word. reach: bytes << 32 | words << 12 | words to the chunk before << 6 | words from the
        key's end to the end of the next key; the latter two count to 63 at most.
        """
        w = Worded(texts, self.powers)
        cut = w.cuts()
        if not len(cut):
            return cut, np.empty(0, np.uint64), cut, cut
        text = w.text[cut]
        end = w.starts[text + 1]
        stop = np.minimum(np.append(cut, len(w.text))[np.searchsorted(cut, cut + self.least)], end)
        same = np.concatenate([[False], text[1:] == text[:-1]])
        before = np.where(same, cut - np.roll(cut, 1), 0)
        after = np.where(np.roll(same, -1), np.roll(stop, -1) - stop, 0)
        base = w.begins[text]
        place = (w.first[cut] - base) << 32 | (cut - w.starts[text])
        reach = (w.stop[stop - 1] - w.first[cut]) << 32 | np.minimum(stop - cut, (1 << 20) - 1) << 12 | np.minimum(before, 63) << 6 | np.minimum(after, 63)
        return text, w.sums.digest(cut, stop), place, reach


def _documents(docs: DataFrame) -> DataFrame:
    """id, t (a digest of the text), text: what tells documents apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("t"), "text").where("length(text) > 0")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """key, n, low, high (ids) of the keys that two documents hold."""
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("t").alias("t_low"), F.max("t").alias("t_high"))
    return sums.where("low <> high or t_low <> t_high").select(key, "n", "low", "high")


def _looked_up(work: Workspace, rows: DataFrame, table: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the columns of a stored table by key; what a large share of rows looks up goes to the map side.

    A key over one in HOT of all rows is among at most HOT such keys, so the broadcast is bounded.
    """
    many = rows.count() / HOT
    hot = work.keep(table.where(F.col("n") > many), f"{label}_hot")
    if hot.isEmpty():
        return rows.join(table, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("n") <= many), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def _each(docs: DataFrame, chunker: Chunker) -> DataFrame:
    """key, id, t, place, reach of every chunk."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for begin, texts in runs(batch.column(2).to_pylist()):
                text, key, place, reach = chunker.chunks(texts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids[begin + text], ts[begin + text], place, reach)], ["key", "id", "t", "place", "reach"])

    return docs.transform(map_batches, chunked, "key long, id long, t long, place long, reach long")


def _lists(batch: pa.RecordBatch, column: int, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number and fields of all elements of a column of lists of structs."""
    lists = batch.column(column)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), {n: np.asarray(flat.field(n)) for n in names}


def _groups(found: DataFrame, min_words: int) -> DataFrame:
    """group, id, t, place, n_bytes, n_words: from every repeated chunk of a run on, as many as have min_words words."""
    powers = Powers()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _lists(batch, 2, ["place", "reach", "key"])
            if not len(row):
                continue
            word, n = x["place"] & 0xFFFFFFFF, x["reach"] >> 12 & 0xFFFFF
            stop = word + n
            joined = np.concatenate([[False], (row[1:] == row[:-1]) & (word[1:] <= stop[:-1])])
            run = np.cumsum(~joined)
            scale = int(stop.max()) + min_words + 1  # runs one after another on a common line
            last = np.searchsorted(run * scale + stop, run * scale + word + min_words)
            whole = last < len(run)
            whole[whole] = run[last[whole]] == run[whole]
            at, last = np.flatnonzero(whole), last[whole]
            key = x["key"].view(np.uint64)
            steps = Sums(mix(key + np.append(np.diff(word), 0).astype(np.uint64) * _POWER), powers)  # a key and how far on the next begins
            digest = mix(steps.digest(at, last) * np.uint64(3) + key[last]).view(np.int64)
            first, end = x["place"][at] >> 32, (x["place"][last] >> 32) + (x["reach"][last] >> 32)
            cols = digest, np.asarray(batch.column(0))[row[at]], np.asarray(batch.column(1))[row[at]], x["place"][at], end - first, stop[last] - word[at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group", "id", "t", "place", "n_bytes", "n_words"])

    return found.transform(map_batches, grouped, "group long, id long, t long, place long, n_bytes long, n_words long")


def wanted_keys(word: np.ndarray, stop: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, done: list[tuple[int, int]], min_words: int) -> list[int]:
    """Which of a document's repeated chunks to search around, so that every possible passage outside done holds one.

    A passage of min_words words holds every chunk that begins over REACH words after its begin and whose key ends
    over REACH words before its end (a chunk's begin depends on one word more to the left).
    """
    out: list[int] = []
    begin = 0
    while begin < len(word):
        end, reach = begin + 1, stop[begin]
        while end < len(word) and word[end] <= reach:
            reach = max(reach, stop[end])
            end += 1
        at, last = max(0, int(word[begin] - before[begin]) - REACH), int(stop[end - 1] + after[end - 1]) + REACH
        while at + min_words <= last:
            over = [b for a, b in done if a < at + min_words and b > at]
            if over:
                at = max(over)
                continue
            later = begin + np.flatnonzero(word[begin:end] > at + REACH)
            if not len(later):
                break
            enters = int(stop[later].min()) + REACH - min_words + 1
            if enters > at:  # no chunk is inside before
                at = enters
                continue
            inside = later[stop[later] + REACH < at + min_words]
            best = min(inside.tolist(), key=lambda i: (n[i], -word[i]))
            out.append(best)
            at = int(word[best]) - REACH
        begin = end
    return out


def _searched(found: DataFrame, passages: DataFrame, min_words: int) -> DataFrame:
    """key: what to search around."""
    ours = passages.groupBy(*_OWN).agg(F.collect_list(F.struct("place", "n_words")).alias("done"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _lists(batch, 0, ["place", "reach", "key", "n"])
            of, d = _lists(batch, 1, ["place", "n_words"])
            word = x["place"] & 0xFFFFFFFF
            stop, before, after = word + (x["reach"] >> 12 & 0xFFFFF), x["reach"] >> 6 & 63, x["reach"] & 63
            done = (d["place"] & 0xFFFFFFFF), (d["place"] & 0xFFFFFFFF) + d["n_words"]
            edges, spans = np.searchsorted(row, np.arange(batch.num_rows + 1)), np.searchsorted(of, np.arange(batch.num_rows + 1))
            keys = []
            for k in range(batch.num_rows):
                a, b = edges[k], edges[k + 1]
                c, e = spans[k], spans[k + 1]
                mine = merged(sorted(zip(done[0][c:e].tolist(), done[1][c:e].tolist(), strict=True)))
                keys += (x["key"][a:b][i] for i in wanted_keys(word[a:b], stop[a:b], before[a:b], after[a:b], x["n"][a:b], mine, min_words))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    empty = F.expr("cast(array() as array<struct<place:long,n_words:long>>)")
    return found.join(ours, _OWN, "left").select("chunks", F.coalesce("done", empty).alias("done")).transform(map_batches, chosen, "key long").distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(docs: DataFrame, around: DataFrame, min_words: int) -> DataFrame:
    """group, id, t, place, n_bytes, n_words of every window of min_words words around the chunks of a document."""
    powers = Powers()

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _lists(batch, 3, ["place", "reach"])
            word = x["place"] & 0xFFFFFFFF
            low = np.maximum(0, word + (x["reach"] >> 12 & 0xFFFFF) - min_words)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for begin, texts in runs(batch.column(2).to_pylist()):
                w = Worded(texts, powers)
                firsts = []
                for k in range(len(texts)):
                    a, b = edges[begin + k], edges[begin + k + 1]
                    size = int(w.starts[k + 1] - w.starts[k])
                    marks, fits = np.zeros(size + 2, np.int64), low[a:b] <= word[a:b]
                    np.add.at(marks, low[a:b][fits], 1)
                    np.add.at(marks, word[a:b][fits] + 1, -1)
                    at = np.flatnonzero(np.cumsum(marks)[: max(0, size - min_words + 1)])
                    firsts.append(at + w.starts[k])
                at = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
                text = w.text[at]
                first = w.first[at]
                cols = w.sums.digest(at, at + min_words).view(np.int64), np.asarray(batch.column(0))[begin + text], np.asarray(batch.column(1))[begin + text]
                cols = *cols, (first - w.begins[text]) << 32 | (at - w.starts[text]), w.stop[at + min_words - 1] - first, np.full(len(at), min_words)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group", "id", "t", "place", "n_bytes", "n_words"])

    return docs.join(around, _OWN).select("id", "t", "text", "chunks").transform(map_batches, windowed, "group long, id long, t long, place long, n_bytes long, n_words long")


def _held_elsewhere(work: Workspace, rows: DataFrame, label: str) -> DataFrame:
    """Groups or windows that another document holds, with low and high."""
    table = work.keep(_repeated(rows, "group"), f"{label}_repeated")
    return work.keep(_looked_up(work, rows, table, "group", label).select(*_OWN, "place", "n_bytes", "n_words", "low", "high"), label)


def repeated_spans(docs: DataFrame, min_words: int = 51, chunker: Chunker | None = None) -> DataFrame:
    """doc_id, text_hash, first_byte, n_bytes, n_words, other_doc, original of every repeated span.

    original: no other holder has a smaller id. Where parts of a passage differ in that, each kind has spans of its own.
    """
    work, chunker = Workspace(docs.sparkSession, "substring_dedup"), chunker or Chunker()
    docs = _documents(docs)
    chunks = work.keep(_each(docs, chunker), "chunks")
    repeated = work.keep(_repeated(chunks, "key"), "repeated")
    found = work.keep(_looked_up(work, chunks, repeated.select("key", "n"), "key", "found"), "found")
    listed = found.groupBy(*_OWN).agg(F.array_sort(F.collect_set(F.struct("place", "reach", "key", "n"))).alias("chunks"))
    listed = work.keep(listed, "listed")

    groups = work.keep(_groups(listed.select(*_OWN, "chunks"), min_words), "groups")
    passages = _held_elsewhere(work, groups, "passages")
    wanted = work.keep(_searched(listed, passages, min_words).join(repeated.select("key", "n"), "key"), "wanted")
    around = _looked_up(work, found.select("key", *_OWN, "place", "reach"), wanted, "key", "around").groupBy(*_OWN).agg(F.collect_set(F.struct("place", "reach")).alias("chunks"))
    windows = work.keep(_windows(docs, work.keep(around, "around"), min_words), "windows")
    passages = passages.unionByName(_held_elsewhere(work, windows, "exact"))

    return work.finish(_spans(passages), "spans")


def _spans(passages: DataFrame) -> DataFrame:
    word: Column = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    byte: Column = F.shiftright("place", 32)
    other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    parts = passages.select(*_OWN, word.alias("w"), (word + F.col("n_words")).alias("w_stop"), byte.alias("b"), (byte + F.col("n_bytes")).alias("b_stop"), other.alias("other"), (F.col("id") == F.col("low")).alias("original"))
    along = Window.partitionBy(*_OWN, "original").orderBy("w", "w_stop")
    apart = F.coalesce(F.col("w") > F.max("w_stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = parts.withColumn("span", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*_OWN, "original", "span")
    spans = spans.agg(F.min("b").alias("first_byte"), F.max("b_stop").alias("b_stop"), (F.max("w_stop") - F.min("w")).alias("n_words"), F.min("other").alias("other"))
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return spans.select(named("id").alias("doc_id"), F.col("t").alias("text_hash"), "first_byte", (F.col("b_stop") - F.col("first_byte")).alias("n_bytes"), "n_words", named("other").alias("other_doc"), "original")


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with every repeated span taken out of the text but where it is the original.

    A row's spans are those of its id and text; rows without any stay as they are.
    """
    names = docs.columns
    i, t, at = (fresh(names, n) for n in ("_id", "_t", "_cuts"))
    cuts = spans.where("not original").groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias(i), F.col("text_hash").alias(t)).agg(F.array_sort(F.collect_list(F.struct("first_byte", "n_bytes"))).alias(at))

    @F.pandas_udf("string")
    def cut(texts, cuts):
        out = []
        for text, of in zip(texts, cuts, strict=True):
            if text is not None and of is not None:
                raw, at, kept = text.encode(), 0, []
                for c in of:
                    kept.append(raw[at : max(at, c["first_byte"])])
                    at = max(at, c["first_byte"] + c["n_bytes"])
                text = b"".join([*kept, raw[at:]]).decode(errors="ignore")
            out.append(text)
        return texts.__class__(out, dtype=object)

    joined = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), t: F.xxhash64("text")}).join(cuts, [i, t], "left")
    return joined.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(cut("text", at))).select(names)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
