"""Connected components of a link table, by alternating large and small stars
(each node's larger neighbours, then itself and its smaller ones, are linked
to the least node near it). Two shuffles a round, a number of rounds that grows
with the logarithm of the longest chain; nothing comes to the driver but a
checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MOST_ROUNDS = 60


def _nearest(links: DataFrame) -> DataFrame:
    """(a, b, m): each link seen from a, and the least node near a."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return links.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component (the least node of its
    component), for every node that has a link to another."""
    edges = C.staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _nearest(large)  # a > b already
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        before, edges = edges, C.staged(small.where("a <> b").distinct(), "links")
        C.free(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError("the stars did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
