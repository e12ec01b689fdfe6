"""Connected components by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, component)``; component is the smallest node.

    Every node that an edge names gets a row; self-loops and repeated edges change
    nothing; rows with a null end are ignored; without edges the result is empty.

    A large-star step hangs every larger neighbour of a node on the smallest one it
    knows, a small-star step does so for the smaller ones; both keep connectivity and
    together reach stars in a number of rounds logarithmic in the longest path.  The
    minima are written before they are joined, so both join inputs are plain exchanges
    and a hub's neighbours can be split over tasks.  Nothing but two counters per round
    reaches the driver.
    """
    known = edges.where("u is not null and v is not null")
    nodes = scratch.table(
        known.select("u").unionByName(known.select(F.col("v").alias("u"))).distinct(), "nodes")
    current = scratch.table(
        known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    seen = _digest(current)
    if seen[0]:
        for _ in range(max_rounds):
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
            large = scratch.table(
                both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                "large")
            scratch.drop(current, low)
            low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            hung = large.join(low, "u")
            current = scratch.table(
                hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(hung.select("u", F.col("m").alias("v")))
                .where("u <> v").distinct(),
                "edges")
            scratch.drop(large, low)
            now = _digest(current)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
