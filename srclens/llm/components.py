"""Connected components over distributed edges: alternating big and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _big(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the smallest node around it."""
    both = e.union(e.select("w", "u")).toDF("u", "w")
    low = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
    return both.filter("w > u").join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """The node and its smaller neighbours get the smallest of them; e holds u > w."""
    low = e.groupBy("u").agg(F.min("w").alias("m"))
    return e.join(low, "u").select(F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("m").alias("w")), F.struct("u", F.col("m").alias("w")))).alias("s")).select("s.u", "s.w").filter("u <> w").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable; nodes has id, edges has u and w (any order, repeats allowed).

    The stars end when a round leaves the edges as they were; each round is a written table."""
    e = stage(edges.filter("u <> w").select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct(), "cc")
    mark = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "w").bitwiseAND((1 << 40) - 1)).alias("s")).first()
        if now == mark or not now.n:
            break
        mark = now
        e = stage(_small(_big(e)), "cc")
    low = e.groupBy(F.col("u").alias("id")).agg(F.min("w").alias("component"))
    return nodes.select("id").join(low, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
