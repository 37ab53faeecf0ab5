"""Connected components of an edge table, distributed, by alternating large-star and small-star steps.

Defined results: an empty table has no components; a link of an id to itself, and links with a null end, say nothing;
repeated links count once. Tables of a round are deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texmill.llm._common import Workspace


def _star(work: Workspace, edges: DataFrame, label: str, large: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest of them and itself.

    edges hold (u, v). Large: each node's larger neighbours; small: each node and its smaller neighbours.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.union(flipped) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    around = work.keep(around, f"{label}_around")
    least = work.keep(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}_least")
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return work.keep(out.where("u <> v").distinct(), label)


def connected_components(links: DataFrame, work: Workspace | None = None, rounds: int = 60) -> DataFrame:
    """links (a, b) -> id, component (the smallest id reachable), for every id that has a link to another."""
    own = work is None
    work = work or Workspace(links.sparkSession, "components")
    begin = work.n
    edges = work.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        done = work.n
        edges = _star(work, _star(work, edges, "large_star", True), "small_star", False)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(begin, done)
        if state == before:
            break
        before, begin = state, done
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    return work.finish(out, "components") if own else out
