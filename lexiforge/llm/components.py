"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of every node move to the least of them.

    edges: (u, v), every pair in both directions for the large step, v < u for
    the small one.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").withColumn("m", F.least("u", "m"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is its component's least node.

    edges: (u, v) of longs, in any direction, repeats and loops allowed.
    Alternates large and small stars until the edges are stars already; each
    round is written to the shared folder, so no lineage grows.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "0")
    mark = None
    for done in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = scratch.put(_star(_star(both, True), False), str(done + 1))
        scratch.drop(str(done))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError("components did not settle")
