"""Connected components of a link table, by alternating star operations.

Each round is two aggregations and two equi-joins, written to the shared folder; hubs are split by Spark's
skew join, and nothing is collected. The number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(sym: DataFrame, smaller: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones and itself) move to the least of its circle."""
    if smaller:
        sym = sym.where("b < a")
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = sym.join(least, "a")
    if not smaller:
        return moved.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    kept = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link in `edges` (a, b longs); root is the least node it reaches.

    No links give no rows; links to itself and repeated links are ignored.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, last = state, links
        links = written(_star(_both(_star(_both(last), smaller=False)), smaller=True), "links")
        discard(last)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
