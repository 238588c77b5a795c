"""Connected components by alternating large-star and small-star rounds.

Each round is two group-bys and two equi-joins on the links alone; the number of rounds grows with
the logarithm of the largest component's diameter.  Hot vertices are pre-aggregated, and their links dealt to
several tasks.  Every round's links are a table of the workspace, and the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, spread_join


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """pairs(u, v): v is a neighbour of u.  Every neighbour is hung on u's least neighbour."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
    hung = spread_join(pairs, least.drop("k"), ["u"], least.select("u", "k"), total, F.xxhash64("v"))
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, ws: Workspace, name: str = "edges", rounds: int = 60) -> DataFrame:
    """(node, label) for every node with a link (a, b); label is the least node of its component."""
    e = ws.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    total, seen = e.count(), None
    for k in range(1, rounds + 1):
        e = _star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, 2 * total)
        e = ws.table(_star(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False, total), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
