"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.storage import stored


def _with_smallest(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Join the smallest neighbour ``_m`` of each ``u``.

    The second key keeps the join from taking over the grouping's
    partitioning, so that Spark can split the edges of a hot node.
    """
    least = least.withColumn("_s", F.pmod("_u", F.lit(64)))
    return edges.join(least, (F.col("u") == F.col("_u")) & (F.pmod("u", F.lit(64)) == F.col("_s")))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_smallest(both, _smallest(both)).where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    joined = _with_smallest(down, least).where("v > _m")
    moved = joined.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each component, for every node with an edge.

    ``edges`` has ``u, v`` (long).  Each round is stored in the shared folder.
    The number of rounds grows with the logarithm of the number of nodes; the
    edges of a hot node are joined, so Spark can split them.
    """
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(current)
    while before[0]:
        current = stored(_small_star(_large_star(current)), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
