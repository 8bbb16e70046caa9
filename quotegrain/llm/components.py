"""Connected components of a table of links, by alternating stars; every step is a join on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node link to the least of all; small star: those below, and the node itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("m <> u").select("u", F.col("m").alias("v"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``links`` (u, v) of one comparable type; returns (node, component): the least node reachable, for linked nodes.

    Loops and repeated links are allowed; nulls are left out; no links give no rows. Rounds grow with the logarithm of
    the longest path; each is written to shared storage, so none is computed again if executors are lost. ``most``: a
    known bound of the links.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", most)
    seal, count = None, edges.count()
    while True:
        # a round makes about as many links as it had
        edges = written(_star(_star(edges, large=True), large=False), "stars", count)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = now[0]
        if now == seal:
            break
        seal = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
