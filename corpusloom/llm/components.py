"""Connected components of a table of edges, by alternating star contraction.

Every round rewires each vertex to the least vertex it knows of. The edges of a round are written to
shared storage, so that lineage stays short; nothing but counts reaches the driver. A vertex with very many
edges, such as the head of a large group, has its edges dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import discard, salted_join, stored


def _rewired(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, what least (u, m, n) says of u; n adds up to total."""
    return salted_join(edges, least, ["u"], "n", F.xxhash64("v"), total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of a vertex go to the least of it and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _rewired(both.filter("v > u"), least, 2 * total).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Smaller neighbours of a vertex, and the vertex, go to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _rewired(edges, least, total).unionAll(least.select("u", F.col("m").alias("v")).filter("u <> v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its least node), for the nodes of edges (u, v: longs)."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        large = stored(_large_star(edges, mark[0]), "large-star")
        small = stored(_small_star(large, max(1, large.count())), "edges")
        discard(edges, large)
        edges, now = small, _mark(small)
        if now == mark:
            break
        mark = now
    rooted = edges.groupBy("u").agg(F.min("v").alias("v"))
    return rooted.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(rooted.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
