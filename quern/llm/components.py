"""Connected components of a table of edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v.  The minima are a written table, so that the join has plain shuffles that Spark can split where one node has most edges."""
    least = materialize(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name).withColumnRenamed("u", "mu")
    return edges.join(least, edges["u"] == least["mu"]).drop("mu")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the component is its least node.

    Self loops, repeated edges and nulls are dropped.  Nothing is gathered on the driver but a count and a checksum for each round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc-edges")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "cc-large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-star")
        small = _with_least(large, "cc-small")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc-edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
