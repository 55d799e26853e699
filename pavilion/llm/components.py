"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Each round points the larger neighbours of every node at its smallest neighbour, then the smaller ones; the number of
    rounds grows with the logarithm of the longest chain. A round is written to the shared folder. Only the number of
    links and a check sum come back to the driver. The smallest neighbours are written before they are joined, so both join
    sides are plain shuffles and Spark can split a hub's.
    """
    edges = staged(_down(links), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = staged(_small_star(staged(_large_star(edges), "star")), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller one."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = staged(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lowest")
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("other"))
    return up.join(low, "a").select(F.col("other").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, linked to the smallest of them."""
    low = staged(edges.groupBy("a").agg(F.min("b").alias("low")), "lowest")
    moved = edges.join(low, "a")
    return _down(moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        low.select("a", F.col("low").alias("b"))))
