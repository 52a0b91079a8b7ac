"""Connected components of an edge table, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _settled(now: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = now.select(F.col("u").alias("k"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("k").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf > 1 or (leaf > 0 and root > 0)").limit(1).isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star contraction until the edges are stars,
    which is tested exactly.  Each round is two aggregations with map-side
    combine and two joins on the node, whose large keys (a star's centre) Spark
    may split, as one side has a row a key; it is written to the shared folder,
    which cuts lineage, and the round before is removed.  No edges give an empty
    table.  A null endpoint drops its edge; self loops keep their node.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "cc-nodes")
    now = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "cc")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    out = written(nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component")), "components")
    discard(nodes, now)
    return out
