"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.session import materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def fingerprint(edges: DataFrame) -> tuple:
    """Two tables with the same number of links and sum of hashes are taken as equal."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first())


def components(edges: DataFrame, left: str, right: str, node: str = "node", root: str = "root") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of its component.

    Links may repeat, run either way and touch themselves; a link with a null end takes no part. An
    empty table gives no rows. Rounds end when nothing changes; each is checkpointed, so a lost
    executor costs at most one round, and their number grows with the logarithm of the largest
    component. A node with very many links only meets combining aggregates and joins; the smallest
    neighbours are checkpointed, so that both sides of a join are plain shuffles and the adaptive
    skew join can split that node's links.
    """
    links = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct()
    links = materialize(links)
    state = fingerprint(links)
    while state[0]:
        links = materialize(small_star(large_star(links).filter("u <> v")).filter("u <> v").distinct())
        after = fingerprint(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
    return links.select(F.col("u").alias(node), F.col("v").alias(root)).union(roots)
