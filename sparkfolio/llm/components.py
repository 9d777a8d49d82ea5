"""Connected components by contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v): nodes of a component share a root, which is one of them.

    In each round a node hands itself to its least neighbour, by an order that is hashed anew, and edges are
    carried over to those; a constant share of the nodes goes each time. Links are only ever grouped by minimum.
    """
    edges = materialise(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not is_empty(edges):
        turn = F.lit(len(rounds))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(turn, "v").alias("h"), F.col("v"))).alias("best"))
        mine = F.struct(F.xxhash64(turn, "u").alias("h"), F.col("u").alias("v"))
        parent = materialise(best.select("u", F.least("best", mine)["v"].alias("p")))
        rounds.append(parent)
        edges = edges.join(parent, "u").select(F.col("p").alias("u"), "v")
        edges = edges.join(parent.withColumnRenamed("u", "v"), "v").select("u", F.col("p").alias("v")).filter("u <> v")
        edges = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = None
    for parent in reversed(rounds):
        if out is None:
            out = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = out.select(F.col("node").alias("p"), "root")
            out = parent.join(up, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    # A node that took itself in one round may have gone on in a later one: the roots' own rows say so.
    return out
