"""Connected components of an edge table by alternating star contractions; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.llm.common import stage

#: Rounds after which a graph is held to be malformed; a path of n nodes needs about log2(n).
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u long, v long. Returns node, label (the smallest node of its component) for every node that has an edge.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest neighbour. Minima are
    aggregated before they are joined back, so a node with very many edges is never gathered in one task.
    """
    both = edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
    current = stage(both, "edges")
    before = _state(current)
    for _ in range(MOST_ROUNDS):
        arcs = current.unionByName(current.selectExpr("v u", "u v"))
        least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = arcs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.selectExpr("u", "m v")).where("u <> v").distinct()
        current = stage(small, "edges")
        now = _state(current)
        if now == before:
            return current.selectExpr("u node", "v label").unionByName(current.selectExpr("v node", "v label").distinct())
        before = now
    raise RuntimeError("the components did not settle")
