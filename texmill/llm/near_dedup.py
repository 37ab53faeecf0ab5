"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles. Its sketch has 128 registers: the hash's first bits choose the
register, which stores the leading-zero count of the smallest remainder and its next 10 bits (16 bits in all).
Four registers side by side are a 64-bit band key, 32 bands in all; documents that share a band are candidates.

* Equal sets are one class from the start, so a group of copies costs one row in every later step.
* In every bucket, all members are held against its most central member (the one whose buckets hold most rows), not
  against each other. Candidates with large sets pass a Jaccard estimate from equal registers, less the expected
  register collisions; the rest and all that pass are confirmed by the intersection of the full sets.
* Buckets that then still hold several components are finished exactly: their members are joined on the rarest
  shingles of each set, as many as any partner at the threshold must share one of, and pairs of different components
  within the positional bound are confirmed. No bucket is capped and no pair is sampled.
* Sets of up to SMALL shingles would leave registers empty, and bands of lent values miss links among them. Each of
  their registers has a hash function of its own instead. Sets near SMALL carry both kinds of bands, so any two sets
  whose sizes allow a link have 32 bands of one kind in common.

Hot buckets meet in plain joins of stored tables (split by adaptive execution) or in aggregates with partial sums.

Defined results: null, empty and blank texts have an empty set, size 0, and are linked with nothing; fewer than five
words make one shingle; rows of a null doc_id are linked with nothing and kept; repeated rows have the same result
each, and without_duplicates() leaves one of them; different texts under one id are one document with the links of
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import Workspace, keep, map_batches, per_batch, read
from texmill.llm.components import connected_components
from texmill.llm.shingles import Words, mix, shingle_set

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: Sets up to this size have registers with a hash function each.
SMALL = 128
#: Up to so many documents to drop are looked up at the map side (some 25 MB); beyond, the documents are joined with them.
LOOKED_UP = 250_000
_FUNCTIONS = np.random.default_rng(271_828).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For every register the registers that lend it a value while it is empty, in order of trial.
_LENDERS = np.random.default_rng(20240229).integers(0, REGISTERS, (48, REGISTERS))


def _compressed(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of 53-bit numbers << 10 | next 10 bits."""
    fraction, bits = np.frexp(rest.astype(np.float64))
    return ((53 - bits) << MANTISSA | np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)).astype(np.uint16)


def registers_of_few(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of non-empty small sets: each register holds the smallest value of a function of its own."""
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for i, by in enumerate(_FUNCTIONS):
        out[:, i] = _compressed(np.minimum.reduceat(mix(values * by), starts) >> np.uint64(11))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of non-empty sorted sets: leading zeros << 10 | next 10 bits, as unsigned 16-bit."""
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
    low = np.empty((len(sets), REGISTERS), np.uint64)
    there = np.empty((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, starts)
        found = s[np.minimum(at, len(s) - 1)]
        low[i], there[i] = found, (at < len(s)) & ((found >> np.uint64(57)) == np.arange(REGISTERS, dtype=np.uint64))
    out = _compressed((low & np.uint64((1 << 57) - 1)) >> np.uint64(4))
    for lender in _LENDERS:
        if there.all():
            break
        take = ~there & there[:, lender]
        out = np.where(take, out[:, lender], out)
        there |= take
    if not there.all():  # very few elements: the first register that has a value lends it
        first = there.argmax(1)
        out = np.where(there, out, out[np.arange(len(out)), first][:, None])
    return out


def bands_of(sets: list[np.ndarray], percent: int) -> list[tuple[int | None, list[int] | None]]:
    """Per set the number of its first band and its band keys: 0 to 31 of the large kind, 32 to 63 of the small one."""
    large = [s for s in sets if 100 * len(s) > percent * SMALL]
    few = [s for s in sets if 0 < len(s) <= SMALL]
    a, b = (iter(of(x).view("<i8").reshape(-1, BANDS).tolist() if x else ()) for of, x in ((registers, large), (registers_of_few, few)))
    out = []
    for s in sets:
        keys = (next(a) if 100 * len(s) > percent * SMALL else []) + (next(b) if 0 < len(s) <= SMALL else [])
        out.append((BANDS * (100 * len(s) <= percent * SMALL), keys) if len(s) else (None, None))
    return out


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t (digest of the text), n (set size), digest of the set as two numbers, first (band), bands (keys; null for an empty set)."""
    words = None

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal words
        words = words if words is not None else Words()
        sets = [shingle_set(t, words, width) for t in batch.column(1).to_pylist()]
        digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
        first, bands = zip(*bands_of(sets, percent), strict=True) if sets else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(first, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "t", "n", "d0", "d1", "first", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).transform(map_batches, per_batch(sketch), "doc_id long, t long, n long, d0 long, d1 long, first int, bands array<long>")


def shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    """id, shingles of every row."""
    words = None

    def arrays(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal words
        words = words if words is not None else Words()
        sets = [shingle_set(t, words, width).view(np.int64) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "shingles"])

    return docs.select("doc_id", "text").transform(map_batches, per_batch(arrays), "id long, shingles array<long>")


def _equal_registers(a: str, b: str) -> Column:
    """How many of the 128 registers agree, from the packed band keys."""
    lane = lambda x, k: F.when(F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    agree = F.zip_with(a, b, lambda x, y: reduce(lambda s, k: s + lane(x.bitwiseXOR(y), k), range(1, ROWS), lane(x.bitwiseXOR(y), 0)))
    return F.aggregate(agree, F.lit(0), lambda s, x: s + x)


def estimate(a: str, b: str, na: str, nb: str) -> Column:
    """Jaccard estimate from agreeing registers of the large kind, corrected for chance agreement of different minima.

    Two different minima share their leading zeros and mantissa with a chance of about 0.17 * 4r / (1 + r)^2 / 2^10
    for a size ratio of r.
    """
    ratio = F.col(na) / F.col(nb)
    chance = F.lit(0.17) * 4 * ratio / ((1 + ratio) * (1 + ratio)) / float(1 << MANTISSA)
    return (_equal_registers(a, b) / float(REGISTERS) - chance) / (1 - chance)


def _pass_estimate(pairs: DataFrame, sets: DataFrame, percent: int, large: int = 256) -> DataFrame:
    """Drop pairs (a, b) of two large sets whose estimate is six deviations under the threshold, or whose sizes exclude it."""
    threshold = percent / 100
    margin = 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    a, b = (sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}")) for c in "ab")
    joined = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.where((F.least("n_a", "n_b") < large) | (estimate("bands_a", "bands_b", "n_a", "n_b") >= threshold - margin)).select("a", "b", "n_a", "n_b")


def _confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    a, b = (shingles.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return pairs.join(b, "b").join(a, "a").where(100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, of every document."""
    return _grouped(docs, width, percent).drop("t")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates() with a digest of each text."""
    docs, work = docs.select("doc_id", "text"), Workspace(docs.sparkSession, "near_dedup")
    keep = work.keep
    sketched = keep(sketches(docs, width, percent), "sketches")
    classes = keep(sketched.where("n > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("set_id")), "classes")
    sets = keep(sketched.join(classes.withColumnRenamed("set_id", "doc_id"), ["doc_id", "d0", "d1"]).dropDuplicates(["doc_id", "d0", "d1"]).select(F.col("doc_id").alias("set_id"), "n", "first", "bands"), "sets")

    banded = sets.select("set_id", "n", "first", F.posexplode("bands").alias("place", "key")).select("set_id", "n", (F.col("first") + F.col("place")).alias("band"), "key")
    shared = keep(banded.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = keep(banded.join(shared, ["band", "key"]), "members")
    central = members.groupBy("set_id").agg(F.sum("c").alias("weight"))
    heads = keep(members.join(central, "set_id").groupBy("band", "key").agg(F.max(F.struct("weight", -F.col("set_id"))).alias("m")).select("band", "key", (-F.col("m.col2")).alias("b")), "heads")
    star = members.join(heads, ["band", "key"]).where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
    star = keep(_pass_estimate(keep(star, "star"), sets, percent), "candidates")

    wanted = star.select(F.explode(F.array("a", "b")).alias("doc_id")).union(members.where("c > 2").select("set_id")).distinct()
    shingles = keep(shingle_arrays(docs.join(keep(wanted, "wanted"), "doc_id", "left_semi"), width), "shingles")
    links = keep(_confirm(star, shingles, percent), "links")
    found = connected_components(links, work)

    rest = _across(work, members, sets, shingles, found, percent)
    more = keep(_confirm(rest, shingles, percent), "more_links")
    if not more.isEmpty():
        found = connected_components(links.union(more), work)

    named = sketched.select("doc_id", "t", "n", "d0", "d1").join(classes, ["d0", "d1"], "left").select("doc_id", "t", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    named = keep(named, "named").join(found.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    component = F.coalesce("component", "set_id", "doc_id")
    out = named.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return work.finish(out, "near_duplicates")


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents with one of each group of near-duplicates, and one of rows that repeat both id and text.

    Of several texts under one id each goes or stays by itself; rows of a null id all stay.
    """
    gone = keep(_grouped(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")).distinct(), "duplicates")
    gone = F.broadcast(gone) if gone.count() <= LOOKED_UP else gone
    rest = docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_t"]), "left_anti").select(docs.columns)
    again = keep(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id"), "repeated_ids")
    if again.isEmpty():
        return rest
    once = rest.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return rest.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def _across(work: Workspace, members: DataFrame, sets: DataFrame, shingles: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can reach the threshold, among the members of buckets with several components.

    Two sets at the threshold share one of their first n - ceil(n * percent / 100) + 1 shingles in any common order. Taken
    from the rarest in this pool on, those are mostly a member's own, which no pair needs.
    """
    keep = work.keep
    components = found.withColumnRenamed("id", "set_id")
    named = keep(members.where("c > 2").join(components, "set_id", "left").select("band", "key", "set_id", "n", F.coalesce("component", "set_id").alias("component")), "open_members")
    several = named.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key")
    pool = keep(named.join(keep(several, "several"), ["band", "key"]).select(F.col("set_id").alias("id"), "n", "component").distinct(), "pool")
    rows = keep(shingles.join(pool.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("s")), "pool_shingles")
    often = keep(rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "pool_counts")
    ordered = rows.join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("shared")).join(pool, "id")
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - F.size("shared"))  # the rarest, its own, come first
    own = F.col("n") - F.size("shared")
    prefixes = ordered.where(length > 0).select("id", "n", "component", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))["s"]).alias("pos", "s"))
    prefixes = keep(prefixes.select("id", "n", "component", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), "s"), "prefixes")
    per = prefixes.groupBy("s", "component").agg(F.count("*").alias("m"))
    main = keep(per.groupBy("s").agg(F.max(F.struct("m", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("s", F.col("x.component").alias("main")), "main")
    tagged = keep(prefixes.join(main, "s"), "tagged")
    left = keep(tagged.where("component <> main").select("s", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("left").alias("left_a")), "minor")
    right = tagged.select("s", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), "main", F.col("left").alias("left_b"))
    near = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))  # what the first shingle they share leaves to share
    once = (F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, [left.s == right.s, F.col("c_a") != F.col("c_b"), near, once]).select("a", "b").distinct()
    return keep(_pass_estimate(keep(pairs, "across"), sets, percent), "across_candidates")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
