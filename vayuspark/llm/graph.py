"""Connected components of links held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to rows (node, component): the smallest node that each linked node reaches.

    Rounds of stars: every node hands its larger, then its smaller neighbours to the smallest one around. Minima are summed
    up before the shuffle and links joined back to them, so a node with very many links is no group in one task. Each round
    is stored; the rounds end when the links no longer change, which takes about the logarithm of the longest path.
    """
    edges = written(_oriented(links), "links")
    mark = _mark(edges)
    while mark[0]:
        # Minima are tables before links are joined with them, so that a node with many links can be split.
        larger = written(_both(edges).groupBy("u").agg(F.min("v").alias("m")), "least")
        wide = _both(edges).join(larger, "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        wide = written(_oriented(wide), "links")
        least = written(wide.groupBy("a").agg(F.min("b").alias("m")), "least")
        # The node and its smaller neighbours all go to the smallest of these.
        close = wide.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(_oriented(close), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
