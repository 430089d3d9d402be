"""Connected components by alternating star contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``: long, any order); the
    root is the least node of the component.

    Each round hooks the larger neighbours of a node onto its least neighbour and
    then the smaller ones; only a minimum per node is aggregated (map-side first),
    and each round's edges are landed in the shared folder, so no lineage grows.
    Rounds go with the logarithm of the longest chain. Nulls are left out."""
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = landed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "edges", release=True)
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct())
        now = landed(small, "edges", release=True)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return (loops.join(now, loops["node"] == now["a"], "left")
            .select("node", F.coalesce("b", "node").alias("root")))
