"""Connected components of an undirected graph given as pairs, by alternating large and small stars.

Each round lowers every node's neighbours to the smallest one seen. Rounds grow with the logarithm of
the longest path. Nothing is collected: the driver reads one count and one checksum a round. Each join meets
a checkpointed table with one row for each node, so that both sides are plain exchanges and the engine can
split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _checksum(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(child, parent))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each neighbour above a node gets the smallest of the node and its neighbours."""
    both = pairs.select(F.col("child").alias("n"), F.col("parent").alias("m")).union(
        pairs.select(F.col("parent").alias("n"), F.col("child").alias("m")))
    least = materialise(both.groupBy("n").agg(F.min("m").alias("least")))
    return (both.join(least, "n").where("m > n")
            .select(F.col("m").alias("child"), F.least("n", "least").alias("parent")).distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and all its smaller neighbours get the smallest of these."""
    least = materialise(pairs.groupBy("child").agg(F.min("parent").alias("least")))
    moved = (pairs.join(least, "child").where("parent > least")
             .select(F.col("parent").alias("child"), F.col("least").alias("parent")))
    return least.select("child", F.col("least").alias("parent")).union(moved).distinct()


def connected_components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns ``node``, ``root``: one row for every node that has a pair, root the smallest node it reaches.

    Pairs of a node with itself, with a null, or repeated change nothing; such nodes may be missing
    from the result and are their own root. No pairs give no rows.
    """
    now = materialise(pairs.where(F.col(left) != F.col(right))
                      .select(F.greatest(left, right).alias("child"), F.least(left, right).alias("parent")).distinct())
    before, seen = None, _checksum(now)
    while seen != before:
        now = materialise(_small_star(materialise(_large_star(now))))  # each star is read twice
        before, seen = seen, _checksum(now)
    return now.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(
        now.select(F.col("parent").alias("node"), F.col("parent").alias("root"))).distinct()
