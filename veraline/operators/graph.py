"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.plans.store import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, a table that they read).  Least neighbours are a table of their own, so that a hub's edges are split among tasks when they meet its."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that some edge names; component is its smallest node.

    Self loops name a node without linking it.  Null ends are dropped.  Each round
    is written to the shared folder, so the lineage stays short and a lost executor
    costs one round.  Rounds grow with the logarithm of the longest chain.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    base = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    current, before = base.where("u <> v"), None
    held = None
    while True:
        stars, least = _large_star(current)
        step = materialize(_small_star(stars), "cc-round")
        discard(least)
        state = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held is not None:
            discard(held)
        current = held = step
        if tuple(state) == before:
            break
        before = tuple(state)
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(current.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
