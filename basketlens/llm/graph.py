"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _lowest(edges: DataFrame) -> DataFrame:
    """Per vertex u the lowest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))


def _figures(edges: DataFrame) -> tuple:
    # a decimal sum: the hashes overflow a long
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex with an edge (u, v); root is the lowest vertex reached.

    Alternates two steps until nothing changes: higher neighbours are hung on the lowest
    neighbour, then lower neighbours are.  Each step only needs the lowest neighbour of a
    vertex, so no neighbourhood is ever collected, and the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut_lineage(edges.distinct())
    before = None
    while (now := _figures(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = (
            both.join(_lowest(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        low = _lowest(hung)
        lower = hung.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut_lineage(lower.unionByName(low.withColumnRenamed("low", "v")).distinct())
    # every edge now leads from a vertex to its root
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
