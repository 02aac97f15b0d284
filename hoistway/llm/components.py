"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame plans.

Every step is a minimum per node (pre-aggregated) and a join with it (hot nodes are split by AQE). Edges are written to the shared folder between
rounds, which cuts lineage; rounds go on until the edges no longer change, about the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    sides = _both(edges)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): label is the least node of its component. Null ends and loops are ignored."""
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = stored(clean, "edges"), None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == tuple(row):
            break
        state = tuple(row)
        after = stored(_small(_large(now)), "edges")
        drop_stored(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
