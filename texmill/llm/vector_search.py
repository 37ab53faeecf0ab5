"""Exact top-k by inner product with vector-approximation files.

1. Every block of vectors is written as cells: each dimension's range is cut into 2^bits equal steps, and only the
   step of each component is stored, with the block's ranges. Exact vectors are not in this file.
2. The file is scanned. For a query the cells alone give an upper and a lower bound of each score; what cannot reach
   the k-th best lower bound is ruled out, first within a task, then over all.
3. Exact vectors are read by id for what is left, in the order of their bounds: first the ``FIRST`` * k highest upper
   bounds of every query, then those of the rest whose bound reaches the k-th exact score. What equals it is still
   read, for ties go to the smaller id.

Queries are a stated set held against all rows in blocks; they reach the tasks in passes of at most ``query_bytes``.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; vectors of different
lengths are never compared; equal vectors tie and go by id; a query has as many rows as it has candidates, at most k.
Rows of one id are one candidate and one query, with the highest score of any of their vectors, and are no candidates
of each other. Rows of a null id take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texmill.llm._common import Workspace, map_batches, read

FIRST = 4
_QUERY = ["query_id", "q"]


def cells_of(exact: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowest value and the step of every dimension, and the step number of every component."""
    low = exact.min(0)
    step = -(-(exact.max(0) - low + 1) // (1 << bits))
    return low, step, ((exact - low) // step).astype(np.uint8 if bits <= 8 else np.uint16)


def bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries with all vectors of a block."""
    q, base = queries.astype(np.float64), low.astype(np.float64) + cells * step.astype(np.float64)
    at_base, room = q @ base.T, (step - 1).astype(np.float64)
    slack = 1e-12 * (np.abs(q) @ np.abs(base).max(0))[:, None]  # for scores that doubles don't hold exactly
    return at_base + (np.minimum(q, 0) @ room)[:, None] - slack, at_base + (np.maximum(q, 0) @ room)[:, None] + slack


class Least:
    """The k-th best lower bound over different ids that each query has seen."""

    def __init__(self, queries: int, k: int):
        self.lower, self.ids, self.k = np.full((queries, k), -np.inf), np.full((queries, k), -1, np.int64), k

    def add(self, at: slice, lower: np.ndarray, ids: np.ndarray) -> None:
        k = min(self.k, lower.shape[1])
        best = np.argpartition(lower, lower.shape[1] - k, 1)[:, lower.shape[1] - k :]
        values = np.concatenate([self.lower[at], np.take_along_axis(lower, best, 1)], 1)
        names = np.concatenate([self.ids[at], ids[best]], 1)
        order = np.lexsort((-values, names), axis=1)
        values, names = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)
        values[:, 1:][names[:, 1:] == names[:, :-1]] = -np.inf
        order = np.argsort(-values, 1, kind="stable")[:, : self.k]
        self.lower[at], self.ids[at] = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)

    def values(self) -> np.ndarray:
        return self.lower[:, -1]


def approximation(vectors: DataFrame, bits: int, block: int) -> DataFrame:
    """size, ids, low, step, cells of every block of at most `block` vectors of one length."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            flat, starts = np.asarray(lists.values), np.asarray(lists.offsets)
            sizes = np.diff(starts)
            rows = []
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                for i in range(0, len(of), block):
                    take = of[i : i + block]
                    low, step, cells = cells_of(flat[starts[take][:, None] + np.arange(size)].reshape(len(take), size), bits)
                    rows.append((size, ids[take].tobytes(), low.tobytes(), step.tobytes(), cells.tobytes()))
            cols = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["size", "ids", "low", "step", "cells"])

    return vectors.select("vec_id", "v").transform(map_batches, blocks, "size int, ids binary, low binary, step binary, cells binary")


def _scan(file: DataFrame, given, k: int, bits: int, together: int = 512, most: int = 1_000_000) -> DataFrame:
    """query_id, q, vec_id, lower, upper of what a task's cells alone can't rule out for a query."""
    names = ["query_id", "q", "vec_id", "lower", "upper"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {size: Least(len(ids), k) for size, (ids, _, _) in given.value.items()}
        held: dict[int, list[tuple[np.ndarray, ...]]] = {size: [] for size in least}

        def prune(size: int) -> None:
            row, ids, lower, upper = (np.concatenate(c) for c in zip(*held[size], strict=True))
            left = upper >= least[size].values()[row]
            held[size] = [(row[left], ids[left], lower[left], upper[left])]

        for batch in batches:
            for size, raw_ids, low, step, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size not in least:
                    continue
                ids, low, step = (np.frombuffer(x, np.int64) for x in (raw_ids, low, step))
                block = np.frombuffer(cells, np.uint8 if bits <= 8 else np.uint16).reshape(len(ids), size)
                order = np.argsort(ids, kind="stable")
                ids, block = ids[order], block[order]
                first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
                ids = ids[first]
                of, _, vectors = given.value[size]
                for i in range(0, len(of), together):
                    at = slice(i, i + together)
                    lower, upper = bounds(vectors[at], low, step, block)
                    if len(first) < lower.shape[1]:  # rows of one id are one candidate
                        lower, upper = (np.maximum.reduceat(x, first, 1) for x in (lower, upper))
                    own = np.searchsorted(ids, of[at])
                    me = np.flatnonzero(ids[np.minimum(own, len(ids) - 1)] == of[at])
                    lower[me, own[me]] = upper[me, own[me]] = -np.inf
                    least[size].add(at, lower, ids)
                    row, col = np.nonzero(upper >= np.maximum(least[size].values()[at], np.finfo(np.float64).min)[:, None])
                    held[size].append((row + i, ids[col], lower[row, col], upper[row, col]))
                if sum(len(x[0]) for x in held[size]) > most:
                    prune(size)
        for size, parts in held.items():
            if parts:
                prune(size)
                row, ids, lower, upper = held[size][0]
                of, q, _ = given.value[size]
                for i in range(0, len(row), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[row[part]], q[row[part]], ids[part], lower[part], upper[part])], names)

    return file.transform(map_batches, scan, "query_id long, q long, vec_id long, lower double, upper double")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, q, vec_id, score: exact vectors are read for these pairs alone."""
    score = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    joined = pairs.join(vectors.select("vec_id", "v"), "vec_id").join(queries.select("query_id", "q", F.col("v").alias("w")), _QUERY)
    return joined.where(F.size("v") == F.size("w")).groupBy(*_QUERY, "vec_id").agg(F.max(score).alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, query_bytes: int = 32_000_000, scan_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for every id of queries its k best other ids of vectors.

    Both have vec_id and v, an array of whole numbers.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "top_k")
    file = work.keep(approximation(vectors, bits, scan_block), "cells")
    queries = work.keep(queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q"), "v").dropDuplicates(_QUERY), "queries")
    total = queries.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    passes = -(-2 * total // query_bytes) if total > query_bytes else 1
    found = None
    for p in range(passes):
        by_size: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toLocalIterator():  # some query_bytes
            by_size.setdefault(len(r.v), []).append((r.query_id, r.q, r.v))
        given = spark.sparkContext.broadcast({size: (*(np.array([x[n] for x in of], np.int64) for n in (0, 1)), np.array([x[2] for x in of], np.int64).reshape(len(of), size)) for size, of in by_size.items()})
        part = work.keep(_scan(file, given, k, bits), "within_bounds")
        found = part if found is None else found.unionByName(part)

    ranked = lambda by: F.row_number().over(Window.partitionBy(*_QUERY).orderBy(*by))
    kth = lambda c, n: F.max(F.when(F.col(n) == k, F.col(c))).over(Window.partitionBy(*_QUERY))
    bound = found.groupBy(*_QUERY, "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper")).withColumn("n", ranked((F.desc("lower"), "vec_id")))
    left = bound.withColumn("least", kth("lower", "n")).where("least is null or upper >= least")
    left = work.keep(left.select(*_QUERY, "vec_id", "upper", ranked((F.desc("upper"), "vec_id")).alias("n")), "left")
    first = work.keep(_exact(left.where(F.col("n") <= FIRST * k), vectors, queries), "first")
    certain = first.withColumn("n", ranked((F.desc("score"), "vec_id"))).where(F.col("n") == k).select(*_QUERY, F.col("score").alias("kth"))
    slack = F.col("kth") - F.abs("kth") * 1e-12
    more = left.where(F.col("n") > FIRST * k).join(certain, _QUERY, "left").where(F.col("kth").isNull() | (F.col("upper") >= slack))
    scores = first.unionByName(_exact(more.select(*_QUERY, "vec_id"), vectors, queries)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return work.finish(out, "neighbours")


def exact_reads(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, block: int = 2048) -> float:
    """Mean number of exact vectors that a query's bounds leave to read, by bounds alone (a measure for tests and tuning)."""
    ids, exact = (np.array(c) for c in zip(*((r.vec_id, r.v) for r in vectors.collect()), strict=True))
    q = [r.vec_id for r in queries.select("vec_id").collect()]
    rows = np.flatnonzero(np.isin(ids, q))
    lower, upper = (np.concatenate(x, 1) for x in zip(*(bounds(exact[rows], *cells_of(exact[i : i + block], bits)) for i in range(0, len(ids), block)), strict=True))
    for x in (lower, upper):
        x[np.arange(len(rows)), rows] = -np.inf
    return float((upper >= np.partition(lower, -k, 1)[:, -k][:, None]).sum(1).mean())


def whole_vectors(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and v = floor(factor * x) of every vector that is there and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(factor * x.cast("double")).cast("long")).alias("v"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
