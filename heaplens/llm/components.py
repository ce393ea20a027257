"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """Each vertex u links its larger (large) or its smaller neighbours and itself to the least of them all."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    # A table of its own, so that the join has an exchange on both sides and can split a hub's edges.
    least = scratch.table(around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"{name}-least")
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return scratch.table(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (the least vertex that it reaches), for the vertices of edges (a, b) of longs.

    A hot vertex's minima are partial before each shuffle, and its edges can be split by the skew join. Self
    loops, repeated edges and an empty table are fine; vertices on no other edge do not appear.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    state, k = None, 0
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        state, k, before = new, k + 1, k
        edges = _star(_star(edges, True, scratch, f"{k}-large"), False, scratch, f"{k}")
        scratch.drop(f"{before}", f"{k}-large-least", f"{k}-large", f"{k}-least")
