"""Connected components of an edge table by alternating large and small stars.

All state is a shuffled edge table; the driver only learns its length and a
checksum. A node with very many neighbours costs one aggregated row and one
join whose large side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest reachable node."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v", F.lit(True).alias("down")).union(pairs.select("v", "u", F.lit(False))).toDF("u", "v", "down")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour is tied to the least node around.
        large = both.where("not down").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: every smaller-or-equal neighbour is tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        seen = Observation()
        pairs = materialise(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
        now = (seen.get["n"], seen.get["h"])
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def joined_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` after further ``edges`` (a, b): only the graph of components is worked on."""
    at_a = components.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    at_b = components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = edges.join(at_a, "a", "left").join(at_b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialise(ends, "components")
    moved = materialise(connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "components").toDF("component", "into")
    new = ends.select(F.col("a").alias("node"), F.col("ca").alias("component")).union(ends.select("b", "cb"))
    every = components.union(new).distinct()
    return every.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
