"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Edges stay distributed. Each step is a minimum per node, combined before the
shuffle, and an equi-join back, so a hub with a third of all edges is split by
adaptive skew joins and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e(u, v) holds every edge from its larger end u to its smaller end v."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        out = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, ws: Workspace, rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (a, b: long)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = ws.table(e, "edges")
    seen = None
    for _ in range(rounds):
        new = ws.table(_star(_star(e, True), False), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def hops(edges: DataFrame) -> DataFrame:
    """node, label: a node of small number that is linked to it for every node of ``edges`` (a, b: long), a few steps away at most.

    Nodes with one label are linked, but one component can have several labels: a cheap part of ``components``.
    """
    e = edges.where("a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low"))
    # the least of the neighbours' own least neighbours, then that node's
    near = both.join(low.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
    near = near.join(low.withColumnRenamed("low", "own"), "node").select("node", F.least("low", "own").alias("low"))
    then = near.select(F.col("node").alias("low"), F.col("low").alias("label"))
    return near.join(then, "low").select("node", "label")
